"""MinHash near-duplicate classes with sequential Bayesian verification.

A document's set holds the distinct 5-word shingles of its lower-cased words (with fewer words, the whole
sequence once). Two documents are linked when 100 * |A & B| >= percent * |A | B|; a class is a connected component.
``Limits`` holds percent and the bands that go with it: 85 for op7's contract (``CONTRACT``), 80 in the pipeline (``STAGE``).

1. One pass over the texts gives each document its set's size, a 128-bit digest of the set, 504 MinHash values,
   one byte of each (its marks), and bands of the first ones (36 of 7 at 85, 46 of 6 at 80). Documents with equal digests collapse into
   one representative, so copies never meet as pairs.
2. In each bucket of a band, every member is paired with the first member and with its neighbour: linear in the bucket,
   whatever its size. Buckets of over 512 members are dealt into slots of half that size at least; each slot has its
   own first member, and those are paired with the bucket's. All bands use one order, and the number of slots is a
   power of two, so members of a large class meet the same few partners in most bands and their pairs collapse.
3. Signature batches of a pair are compared in sequence. After each batch the pair is dropped when the posterior
   probability (uniform prior) of a similarity of percent or more is under ``miss`` = 1e-6.
4. Survivors are checked on the full sets. Linked pairs give components by large-star / small-star rounds.
5. In buckets that still hold several components, every pair between different components is compared by the
   same sequential test, so a link that step 2 did not try is not lost. That happens inside the tasks, in blocks of
   two slots of some 512 members: slots of the bucket's largest component against slots of the rest, and the rest
   among themselves, so the members of one large class are not copied against each other. Members of a pair that passes
   stay, at most one row each; their sets are sent to the block once, the pairs are verified there, and only links that
   join two components of the block become rows. Then the components are made again.

A pair at the limit shares no bucket with a chance of 1e-6 (see ``Limits.miss_chance``). Sets are compared by 64-bit shingle hashes.

Nulls, empty texts and texts without words: an empty set, linked with nothing. Rows that repeat a doc_id count
as one document: the one with the most shingles (then the largest digest). Ties in an order go by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ASCII_SPACE, binary_rows, id_text, mix, rolled, stored, text_chunks, unused, view, words

WORDS, BATCH, HASHES = 5, 42, 504
MISS = 1e-6
SLOT, BROADCAST_IDS = 512, 1_000_000
_SIG = "doc_id long, n_shingles long, digest string, marks binary, bands array<long>"


class Limits(NamedTuple):
    """The least similarity in percent, and the bands of MinHash rows that find pairs of it."""

    percent: int
    bands: int
    rows: int

    def miss_chance(self) -> float:
        """The chance that a pair at the limit shares no band."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands


CONTRACT, STAGE = Limits(85, 36, 7), Limits(80, 46, 6)


@lru_cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return (x[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[1::2] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, first, _ = words(data, offs, ASCII_SPACE)
    r = rolled(w, WORDS)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(r[a : b - WORDS + 1])
        else:
            yield rolled(w[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _digest(items: np.ndarray) -> str:
    """128 bits that depend on the set alone."""
    return f"{int(mix(items).sum()):016x}{int(np.bitwise_xor.reduce(mix(items + np.uint64(77)))) if len(items) else 0:016x}"


def minhash(items: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = a[:, None] * x[None, i : i + 512]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _signatures(limits: Limits):
    _, n_bands, n_rows = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offs in text_chunks(batches):
            sizes, digests, marks, bands = [], [], [], []
            for s in shingle_sets(data, offs):
                sizes.append(len(s))
                digests.append(_digest(s))
                sig = minhash(s)
                marks.append((sig & np.uint32(255)).astype(np.uint8))
                bands.append(sig[: n_bands * n_rows])
            keys = np.zeros((len(ids), n_bands), np.uint64)
            rows = np.array(bands).reshape(len(ids), n_bands, n_rows)
            for j in range(n_rows):
                keys = mix(keys * np.uint64(31) + rows[:, :, j])
            at = pa.array(np.arange(0, n_bands * len(ids) + 1, n_bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), pa.array(digests), binary_rows(marks), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))], ["doc_id", "n_shingles", "digest", "marks", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, offs in text_chunks(batches):
        sets = list(shingle_sets(data, offs))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(_digest, sets))), binary_rows(sets)], ["doc_id", "n", "digest", "items"])


@lru_cache
def least_matches(percent: int = CONTRACT.percent, miss: float = MISS, batch: int = BATCH, total: int = HASHES) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared values a pair with fewer than m matches has a posterior under ``miss``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256  # equal low bytes by chance
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= percent / 100].sum() >= miss * like.sum():
                out.append((n, m))
                break
    return tuple(out)


def _plausible(limits: Limits):
    """Rows (a, b, marks_a, marks_b) that pass every batch of the sequential test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.arange(batch.num_rows)
            if not len(keep):
                continue
            a, b = (np.stack(list(view(batch.column(k), "u1"))) for k in (2, 3))
            before, met = 0, np.zeros(len(keep), np.int64)
            for n, m in least_matches(limits.percent):
                met = met + (a[keep, before:n] == b[keep, before:n]).sum(axis=1)
                keep, met, before = keep[met >= m], met[met >= m], n
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return run


def _is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have percent or more in common."""
    both = len(x) + len(y)
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or len(small) * 100 < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    met = int((large[at] == small).sum())
    return 100 * met >= percent * (both - met)


def _linked(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_is_link(x, y, limits.percent) for x, y in zip(view(batch.column(2), "u8"), view(batch.column(3), "u8"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id in a link.

    Large-star / small-star rounds; each round is written to the shared folder. Group sizes never matter: a
    neighbourhood is only ever reduced to its minimum and joined back.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


_MEMBER = ["block", "rep", "c", "slot", "marks", "band", "bands"]


def _open_pairs(t: pa.Table, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of plausible pairs of different components within each block of rows (``_MEMBER``) in order of block.

    A pair is only looked at in the first band that it shares, and where two slots meet only across them: pairs within
    one slot are met in that slot's own block.
    """
    block, c, slot = (t.column(k).to_numpy() for k in ("block", "c", "slot"))
    marks = np.stack(list(view(t.column("marks").combine_chunks(), "u1")))
    band = t.column("band").to_numpy()
    keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, limits.bands)
    several = t.column("two").to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
        x, y = np.triu_indices(b - a, 1) if b - a <= 64 else (None, None)
        for i in [None] if x is not None else range(a, b - 1):
            p, q = (x + a, y + a) if i is None else (np.full(b - i - 1, i), np.arange(i + 1, b))
            apart = c[p] != c[q]
            if several[a]:
                apart &= slot[p] != slot[q]
            p, q = p[apart], q[apart]
            earlier = (keys[p, : band[a]] == keys[q, : band[a]]).any(axis=1)
            p, q = p[~earlier], q[~earlier]
            met, before = np.zeros(len(p), np.int64), 0
            for n, m in least_matches(limits.percent):
                met += (marks[p, before:n] == marks[q, before:n]).sum(axis=1)
                p, q, met, before = p[met >= m], q[met >= m], met[met >= m], n
            if len(p):
                yield p, q


def _by_block(work):
    """``work`` over tables of whole blocks, from rows in order of block; a block is some two slots of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            block = t.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1])) if len(block) else 0
            if cut:
                yield from work(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from work(t)

    return run


def _suspects(limits: Limits):
    """The rows that are in a plausible pair."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(t.num_rows, bool)
        for p, q in _open_pairs(t, limits):
            hit[p] = hit[q] = True
        yield from t.filter(pa.array(hit)).to_batches()

    return _by_block(work)


def _joining(limits: Limits):
    """Links (a, b) between components, at most one fewer than a block has components, from rows (``_MEMBER``, two, items) in order of block."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, c = t.column("rep").to_numpy(), t.column("c").to_numpy()
        block, items = t.column("block").to_numpy(), list(view(t.column("items").combine_chunks(), "u8"))
        root: dict[tuple[int, int], int] = {}

        def top(where: int, x: int) -> int:
            path = []
            while (up := root.get((where, x), x)) != x:
                path.append(x)
                x = up
            for y in path:
                root[where, y] = x
            return x

        found = []
        for ps, qs in _open_pairs(t, limits):
            for p, q in zip(ps.tolist(), qs.tolist(), strict=True):
                x, y = top(block[p], c[p]), top(block[p], c[q])
                if x != y and _is_link(items[p], items[q], limits.percent):
                    root[block[p], max(x, y)] = min(x, y)
                    found.append((rep[p], rep[q]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)) if len(pairs) else pa.array([], pa.int64()), pa.array(pairs.max(axis=1)) if len(pairs) else pa.array([], pa.int64())], ["a", "b"])

    return _by_block(work)


def _chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with one of ``ids``: by broadcast while the ids are few, by shuffle beyond."""
    ids = ids.distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, limits: Limits = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document; see the module's docstring."""
    texts = id_text(docs)
    sig = stored(texts.mapInArrow(_signatures(limits), _SIG), "signatures")
    one = sig
    if not sig.groupBy("doc_id").count().where("count > 1").isEmpty():
        one = sig.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "digest", "marks", "bands")).alias("x")).select("doc_id", "x.*")
    reps = one.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("marks", "doc_id").alias("marks"), F.min_by("bands", "doc_id").alias("bands"))
    reps = stored(reps, "representatives")

    keys = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    hot = stored(keys.groupBy("band", "key").agg(F.expr(f"cast(pow(2, ceil(log2(count(*) / {SLOT}))) as long)").alias("slots")).where("slots > 1"), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS // 10 else hot
        keys = keys.join(hot, ["band", "key"], "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    else:
        keys = keys.withColumn("slots", F.lit(1).cast("long"))
    keys = keys.withColumn("slot", F.expr("pmod(xxhash64(rep), slots)"))
    w = "partition by band, key, slot order by xxhash64(rep, 1), rep"
    buckets = keys.selectExpr("rep", "band", "key", "slots", f"first_value(rep) over ({w}) as hub", f"lag(rep) over ({w}) as beside", f"lead(rep) over ({w}) as next")
    buckets = stored(buckets.where("slots > 1 or beside is not null or next is not null").drop("next"), "shared-buckets")
    tried = buckets.select("rep", F.explode(F.array("hub", "beside")).alias("other")).where("other is not null and other <> rep")
    if n_hot:  # the slots of a hot bucket meet by their hubs
        hubs = buckets.where("slots > 1 and rep = hub").select("band", "key", "rep")
        first = hubs.groupBy("band", "key").agg(F.min("rep").alias("other"))
        tried = tried.unionByName(hubs.join(first, ["band", "key"]).where("rep <> other").select("rep", "other"))
    tried = stored(tried.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), "candidates")
    m = reps.select("rep", "marks")
    left, right = m.select(F.col("rep").alias("a"), F.col("marks").alias("ma")), m.select(F.col("rep").alias("b"), F.col("marks").alias("mb"))
    likely = tried.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(_plausible(limits), "a long, b long")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(doc_id, items) of the given documents."""
        return _chosen(texts, ids).mapInArrow(_sets, "doc_id long, n long, digest string, items binary").groupBy("doc_id").agg(F.max_by("items", F.struct("n", "digest")).alias("items"))

    likely = stored(likely, "likely")
    sets = sets_of(likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"))
    links = stored(likely.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(_linked(limits), "a long, b long"), "links")
    found = components(links)
    placed = buckets.select("rep", "band", "key").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "band", "key", F.coalesce("component", "rep").alias("c"))
    # of each bucket with several components: its largest, and how many slots that and the others fill
    parts = placed.groupBy("band", "key", "c").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    parts = parts.selectExpr("band", "key", "most.c as big", f"ceil(most.n / {SLOT}) as of_big", f"ceil((n - most.n) / {SLOT}) as of_rest")
    open_ = placed.join(parts, ["band", "key"]).join(reps.select("rep", "marks", "bands"), "rep").selectExpr("*", "c = big as is_big", "pmod(xxhash64(rep), if(c = big, of_big, of_rest)) as own")
    # the largest against the rest: every slot of one meets every slot of the other
    across = open_.withColumn("there", F.explode(F.expr("sequence(0L, if(is_big, of_rest, of_big) - 1)"))).selectExpr("xxhash64(band, key, 'a', if(is_big, own, there), if(is_big, there, own)) as block", "rep", "c", "if(is_big, 1L, 0L) as slot", "marks", "band", "bands", "true as two")
    # the rest among themselves: blocks of two slots
    rest = open_.where("not is_big").withColumn("there", F.explode(F.expr("sequence(0L, of_rest - 1)"))).selectExpr("xxhash64(band, key, 'b', least(own, there), greatest(own, there)) as block", "rep", "c", "own as slot", "marks", "band", "bands", "own <> there as two")
    blocks = across.unionByName(rest)
    schema = "block long, rep long, c long, slot long, marks binary, band int, bands array<long>, two boolean"
    suspects = stored(blocks.repartition("block").sortWithinPartitions("block", "rep").select(*_MEMBER, "two").mapInArrow(_suspects(limits), schema), "suspects")
    met = suspects.join(sets_of(suspects.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep"), "rep").select(*_MEMBER, "two", "items")
    more = met.repartition("block").sortWithinPartitions("block", "rep").mapInArrow(_joining(limits), "a long, b long")
    found = components(links.unionByName(stored(more, "more-links"))).withColumnRenamed("id", "rep")

    member = reps.select("digest", "n_shingles", "rep").join(found, "rep", "left").select("digest", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = one.select("doc_id", "n_shingles", "digest").join(member, ["digest", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))


def keep_one_of_each(docs: DataFrame, limits: Limits = STAGE) -> DataFrame:
    """The documents without all but the first of each near-duplicate class. Rows without a doc_id go."""
    name = unused(docs, "kept_id")
    kept = near_duplicates(docs, limits).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col("doc_id") == F.col(name), "left_semi")


#: DuckDB SQL for ``near_duplicates`` at the contract's limit: all shared shingles joined, and classes by recursion.
ORACLE_SQL = r"""
with recursive given as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as w from documents),
words as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i, len(w) as n from given),
runs as (select doc_id, n, w || ' ' || lead(w, 1) over (order by doc_id, i) || ' ' || lead(w, 2) over (order by doc_id, i) || ' ' || lead(w, 3) over (order by doc_id, i) || ' ' || lead(w, 4) over (order by doc_id, i) as s, i from words),
each as (select distinct doc_id, hash(s) as x from runs where i <= n - 4 union select doc_id, hash(array_to_string(w, ' ')) from given where len(w) between 1 and 4),
shingles as (select g.doc_id, count(x) as n from given g left join each using (doc_id) group by g.doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join shingles p on p.doc_id = a join shingles q on q.doc_id = b where 100 * pairs.n >= 85 * (p.n + q.n - pairs.n)),
reach(doc_id, other) as (select doc_id, doc_id from shingles union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select s.doc_id, s.n as n_shingles, m.component_id, m.component_id = s.doc_id as kept
from shingles s join (select doc_id, min(other) as component_id from reach group by doc_id) m using (doc_id)
"""
