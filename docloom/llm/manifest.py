"""Merkle manifest of a table: one root over groups of rows, and for every row a proof against it.

A row is a leaf. In each group the leaves stand in a given order; every two consecutive nodes become the hash of both, a last
one alone the hash of itself, until one is left: the group's subroot. The subroots, in order of group, give the root likewise.

1. Leaves are hashed in the frame, numbered over a range partitioning by group and order (so the largest group is spread over
   all tasks), and only their hashes move.
2. Aligned buckets of 4,096 places go to tasks as Arrow tables. There DuckDB makes the levels, one ordered ``string_agg`` and
   ``sha256`` query each, and looks up the sibling of every place on every level.
3. The buckets' roots are the leaves of the next tier, until each group has one node; the subroots go through the same tiers.
4. Spark joins each bucket's outer proof to its rows. A proof is an array of (first, node): the sibling hash of each level
   and whether it stands first; null where a node had none.

``folded`` hashes a leaf along its proof. Null values are leaves' fields of their own (``-``). Rows that are alike are each a leaf;
order ties go by leaf hash, and nulls come first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored

BITS, BROADCAST_ROWS = 12, 50_000
_STEPS = "array<struct<first:boolean,node:string>>"
_STEP_LIST = pa.list_(pa.struct([("first", pa.bool_()), ("node", pa.string())]))

LEVEL = """
insert into nodes
select level + 1, pos // 2, sha256(string_agg(node, '' order by pos)) from nodes where level = ? group by level, pos // 2
"""
PROOF = """
select p.pos, list({'first': (p.pos >> p.level) & 1 = 1, 'node': n.node} order by p.level) as steps
from (select pos, unnest(range(?)) as level from nodes where level = 0) p
left join nodes n on n.level = p.level and n.pos = xor(p.pos >> p.level, 1)
group by p.pos order by p.pos
"""


def field(c: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; null as a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf gives along a proof."""
    both = lambda at, s: F.when(s["first"], F.concat(s["node"], at)).otherwise(F.concat(at, F.coalesce(s["node"], F.lit(""))))
    return F.aggregate(steps, start, lambda at, s: F.sha2(F.when(s["node"].isNull(), at).otherwise(both(at, s)), 256))


def siblings(steps: Column) -> Column:
    """The digest of a proof: its sibling hashes, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["node"]), ""), 256)


def _bucket(bits: int):
    """One bucket (tree, n, bucket, pos, node, ...) in order of place, with each place's proof (steps) and the bucket's root."""

    def run(t: pa.Table) -> pa.Table:
        import duckdb

        t = t.sort_by("pos")
        n = t.column("n")[0].as_py() if t.num_rows else 0
        height = bits if n > 1 << bits else max(0, n - 1).bit_length()
        con = duckdb.connect(config={"threads": 1})
        con.register("given", pa.table({"pos": t.column("pos").to_numpy() & ((1 << bits) - 1), "node": t.column("node")}))
        con.execute("create table nodes as select 0 as level, pos, node from given")
        for level in range(height):
            con.execute(LEVEL, [level])
        roots = con.execute("select node from nodes where level = ?", [height]).fetchall()
        steps = con.sql(PROOF, params=[height]).to_arrow_table().column("steps") if height else pa.array([[]] * t.num_rows, _STEP_LIST)
        con.close()
        return t.append_column("steps", steps.cast(_STEP_LIST)).append_column("root", pa.array([r for r, in roots] * t.num_rows, pa.string()))

    return run


def _beside(large: DataFrame, small: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """Rows of ``large`` with those of ``small``: sent to all tasks while they are few, else met by key."""
    return large.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


def proofs(nodes: DataFrame, n_nodes: int, longest: int, bits: int = BITS) -> DataFrame:
    """The nodes (tree, n, pos, node, ...) with steps, their proof, and top, the last node of their tree. ``longest``: nodes of the largest tree."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name not in ("tree", "n", "pos", "node")]
    names = [f.name for f in nodes.schema if f.name not in ("tree", "n", "pos", "node")]
    tiers: list[tuple[DataFrame, int]] = []
    level = nodes
    while True:
        shaped = level.select("tree", "n", F.shiftright("pos", bits).alias("bucket"), "pos", "node", *names)
        schema = ", ".join(["tree long, n long, bucket long, pos long, node string", *kept, f"steps {_STEPS}, root string"])
        tier = stored(shaped.groupBy("tree", "bucket").applyInArrow(_bucket(bits), schema), "manifest-tier")
        tiers.append((tier, n_nodes))
        if longest <= 1 << bits:
            break
        level = tier.where(f"pos = shiftleft(bucket, {bits})").select("tree", F.expr(f"cast(ceil(n / {1 << bits}) as long)").alias("n"), F.col("bucket").alias("pos"), F.col("root").alias("node"))
        names, kept = [], []
        n_nodes, longest = level.count(), -(-longest >> bits)
    upper, rows = tiers.pop()
    while tiers:
        outer = upper.select("tree", F.col("pos").alias("bucket"), F.col("steps").alias("outer"), F.col("root").alias("top"))
        lower, more = tiers.pop()
        upper = _beside(lower, outer, rows, ["tree", "bucket"]).withColumns({"steps": F.concat("steps", "outer"), "root": F.col("top")}).drop("outer", "top")
        rows = more
    return upper.drop("bucket").withColumnRenamed("root", "top")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their place in the whole order from 0; written once. The window sees one row for each partition."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, name)
    part = F.shiftright("at", 33)
    before = ranged.groupBy(part.alias("part")).count().selectExpr("part", "coalesce(sum(count) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return ranged.join(F.broadcast(before), part == F.col("part")).withColumn("at", F.expr("before + (at & 8589934591)")).drop("part", "before")


def manifest(rows: DataFrame, by: Column, order: Column, hashed: Iterable[Column], also: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """(id, leaf, steps, subroot, root, and the columns of ``also``) of each row: a tree for each value of ``by``, leaves ascending by ``order``."""
    also = also or {}
    leaves = rows.select(by.alias("grp"), order.alias("id"), leaf(hashed).alias("node"), *[c.alias(f"also_{k}") for k, c in also.items()])
    leaves = numbered(stored(leaves, "hashed"), ["grp", "id", "node"], "leaves")  # finding the ranges reads its input once more
    groups = stored(leaves.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n")), "groups")
    n_groups, longest, n_leaves = groups.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    if not n_groups:
        return leaves.select("id", F.col("node").alias("leaf"), F.lit(None).cast(_STEPS).alias("steps"), *[F.lit(None).cast("string").alias(x) for x in ("subroot", "root")], *[F.col(f"also_{k}").alias(k) for k in also])
    groups = numbered(groups, ["grp"], "ordered-groups").withColumnRenamed("at", "tree")
    small = F.broadcast(groups) if n_groups <= BROADCAST_ROWS else groups
    leaves = leaves.join(small.select(F.col("grp").alias("g"), "first", "n", "tree"), F.col("grp").eqNullSafe(F.col("g"))).withColumn("pos", F.expr("at - first")).drop("grp", "g", "at", "first")
    inner = proofs(leaves, n_leaves, longest, bits)
    subroots = inner.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("top").alias("node"))
    outer = proofs(subroots, n_groups, n_groups, bits).select(F.col("pos").alias("tree"), F.col("steps").alias("outer"), F.col("top").alias("root"))
    out = _beside(inner, outer, n_groups, ["tree"])
    return out.select("id", F.col("node").alias("leaf"), F.concat("steps", "outer").alias("steps"), F.col("top").alias("subroot"), "root", *[F.col(f"also_{k}").alias(k) for k in also])


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, checked with rows of which every seventh (by crc32 of doc_id) was tampered with."""
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(c["doc_id"].cast("string")) % 7 == 0
    changed = leaf((c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1}).values())
    m = manifest(docs, c["lang"], c["doc_id"], c.values(), {"presented": F.when(hit, changed).otherwise(leaf(c.values()))})
    m = m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings(F.col("steps")).alias("proof_sha256"), folded(F.col("presented"), F.col("steps")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL for ``document_manifest``: all levels by recursion, the CRC by its table.
ORACLE_SQL = """
with recursive entry(i, k, v) as (
  select i, 0, i from range(256) t(i)
  union all
  select i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from entry where k < 8),
crc as (select list(v order by i) as t from entry where k = 8),
given as (
  select doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 7 = 0 as hit
  from documents, crc),
fields as (
  select lang, doc_id,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as front,
    coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as n, coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') as changed,
    coalesce(strlen(text) || ':' || text, '-') as tail, hit
  from given),
leaves as (
  select lang, doc_id, sha256(front || n || tail) as leaf, sha256(front || case when hit then changed else n end || tail) as presented from fields),
numbered as (
  select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaves),
nodes(lang, level, pos, n, node) as (
  select lang, 0, pos, n, leaf from numbered
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from nodes where n > 1 group by lang, level, pos // 2, n),
subroots as (
  select lang, node as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops(level, pos, n, node) as (
  select 0, pos, n, subroot from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from tops where n > 1 group by level, pos // 2, n),
steps as (
  select v.lang, v.doc_id, v.leaf, h.level, case when (v.pos >> h.level) & 1 = 1 then 'l' else 'r' end || coalesce(s.node, '') as step
  from numbered v join (select distinct lang, level from nodes where n > 1) h on v.lang is not distinct from h.lang
  left join nodes s on s.lang is not distinct from v.lang and s.level = h.level and s.pos = xor(v.pos >> h.level, 1)),
inner_steps as (select lang, doc_id, leaf, list(step order by level) as steps from steps group by lang, doc_id, leaf),
outer_steps as (
  select v.lang, v.subroot, list(case when (v.pos >> h.level) & 1 = 1 then 'l' else 'r' end || coalesce(s.node, '') order by h.level) filter (h.level is not null) as steps
  from subroots v left join (select distinct level from tops where n > 1) h on true left join tops s on s.level = h.level and s.pos = xor(v.pos >> h.level, 1)
  group by v.lang, v.subroot),
proved as (
  select v.doc_id, v.leaf, v.presented, o.subroot, (select node from tops where n = 1) as root, coalesce(i.steps, []) || coalesce(o.steps, []) as steps
  from numbered v left join inner_steps i on i.lang is not distinct from v.lang and i.doc_id = v.doc_id and i.leaf = v.leaf join outer_steps o on o.lang is not distinct from v.lang),
checked as (
  select *, list_reduce(list_prepend(presented, steps), lambda h, s: sha256(case when s[1] = 'l' then s[2:] || h else h || s[2:] end)) as folded_root from proved)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from checked
"""
