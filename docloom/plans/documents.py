"""Registered queries over document structure, context and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import catalog as C
from docloom.operators import structure as S
from docloom.plans.queries import collapse_sql, query, tags_sql, values

# lines of the documents table, every fifth a heading of a derived level
LINES_SQL = "l as (select doc_id, pos, line, case when pos % 5 = 0 then 1 + (doc_id + pos) % 3 end as level, case when pos % 5 = 0 then 'h' || pos end as title from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents))"
_W = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"
PATH_SQL = f"""r as (select *, max(case when level = 1 then pos end) {_W} as p1, max(case when level = 2 then pos end) {_W} as p2, max(case when level = 3 then pos end) {_W} as p3 from l),
  h as (select *, list_filter([case when p1 is not null then 'h' || p1 end, case when p2 > coalesce(p1, -1) then 'h' || p2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then 'h' || p3 end], lambda x: x is not null) as path from r)"""


def levelled(read) -> DataFrame:
    rows = S.lines(read("documents"))
    return rows.withColumn("level", F.when(F.col("pos") % 5 == 0, 1 + (F.col("doc_id") + F.col("pos")) % 3)).withColumn("title", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("h"), F.col("pos"))))


@query(f"with {LINES_SQL}, {PATH_SQL} select doc_id, pos, array_to_string(path, '>') as path from h")
def heading_path(spark, read):
    return S.heading_paths(levelled(read), deepest=3).select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("heading_path", ">").alias("path"))


@query(f"""with {LINES_SQL}, {PATH_SQL}, s as (select *, sum(case when level is not null then 1 else 0 end) {_W} as section from h)
  select doc_id, section::bigint as section, min(pos) as first_pos, max(pos) as last_pos, string_agg(line, chr(10) || chr(10) order by pos) as content, array_to_string(min_by(path, pos), '>') as path from s group by doc_id, section""")
def sections(spark, read):
    out = S.sections(S.heading_paths(levelled(read), deepest=3))
    return out.select("doc_id", F.col("section").cast("long").alias("section"), F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"), "content", F.array_join("heading_path", ">").alias("path"))


@query(f"""with {LINES_SQL}, {PATH_SQL}, s as (select *, sum(case when level is not null then 1 else 0 end) {_W} as section from h), u as (select doc_id, section, null as child from s group by all union all select doc_id, section, pos from s where level is null),
  k as (select *, sum(case when child is null then 1 else 0 end) over w as p, sum(case when child is null then 0 else 1 end) over w as c, row_number() over w - 1 as chunk_index from u window w as (partition by doc_id order by section, child is not null, child rows between unbounded preceding and current row))
  select doc_id, chunk_index, 'v' || doc_id || case when child is null then '::p::' || lpad(p::varchar, 4, '0') else '::c::' || lpad(c::varchar, 4, '0') end as chunk_key from k""")
def chunk_keys(spark, read):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = levelled(read).withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    parents = rows.select("doc_id", "section").distinct().withColumn("child", F.lit(None).cast("int"))
    units = parents.unionByName(rows.where("level is null").select("doc_id", "section", F.col("pos").alias("child"))).withColumn("version_key", F.concat(F.lit("v"), F.col("doc_id")))
    return S.chunk_keys(units).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_key")


@query("select page_id // 3 as doc_id, string_agg('<!-- page: ' || (page_id % 3 + 1) || ' -->' || chr(10) || chr(10) || md5(html), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_id) as text from pages group by page_id // 3")
def pages_render(spark, read):
    """Three pages each as one document."""
    return S.rendered(read("pages").select(F.floor(F.col("page_id") / 3).alias("doc_id"), (F.col("page_id") % 3 + 1).alias("page_number"), F.concat(F.lit(" "), F.md5("html"), F.lit(" ")).alias("content")))


MARKED = "case pos % 7 when 0 then '# ' || line when 1 then '1.2) ' || line when 2 then 'b. ' || line when 3 then '- ' || line when 4 then '~~~' when 5 then 'x ' || line else ' ' end"


@query(f"with {LINES_SQL} select doc_id, pos, case when pos % 7 = 4 then 'fence' when pos % 7 = 6 then 'blank' when pos % 7 = 5 or trim(line) = '' then 'text' else ['heading', 'numbered_item', 'lettered_item', 'bullet_item'][1 + pos % 7] end as kind from l")
def line_class(spark, read):
    """Every line behind a mark by its number; a mark with nothing behind it is text."""
    return levelled(read).withColumn("m", F.expr(MARKED)).select("doc_id", F.col("pos").cast("long").alias("pos"), S.line_class("m").alias("kind"))


@query(f"with {LINES_SQL}, {PATH_SQL} select doc_id, pos, case when level is not null then case when pos % 10 = 0 then 'article' else 'none' end when len(list_filter(path, lambda x: x like '%0')) > 0 then ['none', 'clause', 'point', 'bullet', 'none'][1 + pos % 5] else 'none' end as unit from h")
def legal_unit(spark, read):
    """Every tenth line an article, every fifth another heading, the lines below items by their number."""
    rows = levelled(read).withColumn("title", F.when(F.col("title").endswith("0"), F.concat(F.lit("ĐIỀU "), "title")).otherwise(F.col("title")))
    kind = F.element_at(F.array(*map(F.lit, ("heading", "numbered_item", "lettered_item", "bullet_item", "paragraph"))), (F.col("pos") % 5 + 1).cast("int"))
    return S.heading_paths(rows, deepest=3).select("doc_id", F.col("pos").cast("long").alias("pos"), S.legal_unit(kind, F.col("title"), F.col("heading_path")).alias("unit"))


# ---- folds


@query()
def split_long(spark, read):
    units = read("documents").select("doc_id", F.lit(0).alias("source_order"), F.lit("paragraph").alias("block_type"), F.col("text").alias("content"))
    return S.pieces(units)


_ROWS = "len(string_split(text, chr(10)))"
_PARTS = "p as (select doc_id, n, cast(ceil(n / 10.0) as bigint) as parts from (select doc_id, {rows} as n from documents)), r as (select doc_id, n, parts, i, unnest(range(10 * i + 1, least(10 * i + 10, n) + 1)) as row from p, unnest(range(parts)) as t(i))"


def _unit(read, kind: str, head: str, row, tail: str):
    """A block for each document, of as many rows as its text has lines."""
    rows = F.transform(F.sequence(F.lit(1), F.size(F.split("text", "\n"))), row)
    return read("documents").select("doc_id", F.lit(0).alias("source_order"), F.lit(kind).alias("block_type"), F.concat(F.lit(head), F.array_join(rows, "\n"), F.lit(tail)).alias("content"))


@query(f"with {_PARTS.format(rows=_ROWS)} select doc_id, i as split_index, parts as split_count, '| n | v |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lpad(row::varchar, 6, '0') || ' | row |', chr(10) order by row) as content from r group by doc_id, i, parts")
def split_table(spark, read):
    """Ten rows of 16 characters fit beside the head."""
    units = _unit(read, "table", "| n | v |\n|---|---|\n", lambda i: F.concat(F.lit("| "), F.lpad(i.cast("string"), 6, "0"), F.lit(" | row |")), "")
    return S.pieces(units, 200).select("doc_id", *[F.col(n).cast("long").alias(n) for n in ("split_index", "split_count")], "content")


@query(f"with {_PARTS.format(rows=_ROWS)} select doc_id, i as split_index, parts as split_count, '```py' || chr(10) || string_agg('x = ' || lpad(row::varchar, 6, '0'), chr(10) order by row) || chr(10) || '```' as content from r group by doc_id, i, parts")
def split_code(spark, read):
    """Ten lines of 10 characters fit between the fences."""
    units = _unit(read, "code", "```py\n", lambda i: F.concat(F.lit("x = "), F.lpad(i.cast("string"), 6, "0")), "\n```")
    return S.pieces(units, 120).select("doc_id", *[F.col(n).cast("long").alias(n) for n in ("split_index", "split_count")], "content")


@query(f"""with recursive {LINES_SQL}, b as (select doc_id, pos, length(line) as n, row_number() over (partition by doc_id order by pos) as i from l where level is null),
  k(doc_id, i, pos, pack, used, count) as (select doc_id, i, pos, 1, n, 1 from b where i = 1
    union all select b.doc_id, b.i, b.pos, case when fits then pack else pack + 1 end, case when fits then used + n else n end, case when fits then count + 1 else 1 end from (select b.*, k.pack, k.used, k.count, b.pos = k.pos + 1 and k.used + k.count + b.n <= 1200 as fits from k join b on b.doc_id = k.doc_id and b.i = k.i + 1) b)
  select doc_id, pos, pack::bigint as pack from k""")
def bullet_pack(spark, read):
    rows = levelled(read).where("level is null").select("doc_id", "pos", F.lit("p").alias("parent"), "line")
    return S.bullet_groups(rows, 1200).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("pack").cast("long").alias("pack"))


@query()
def context(spark, read):
    """Ten documents each as the hits of a question."""
    group = F.floor(F.col("doc_id") / 10)
    hits = read("documents").select(group.alias("query_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("rank"), F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_key"), F.col("source").alias("title"), F.lit("x, trang 1").alias("citation"), F.col("text").alias("content"), F.col("source").alias("parent_key"), F.repeat(F.col("source"), 60).alias("parent_content"))
    return S.contexts(hits)


# ---- context and conversation


@query("""with a as (select user_id, event_id, row_number() over (partition by user_id, event_type, value::bigint % 10 order by ts, event_id) as n, event_type || '-' || (value::bigint % 10) as k, ts from events where value is not null), f as (select * from a where n = 1)
  select user_id, string_agg(k, ',' order by ts, event_id) as used from (select * from f qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 100) group by user_id""")
def used_keys(spark, read):
    e = read("events").where("value is not null").select("user_id", "ts", "event_id", F.concat(F.col("event_type"), F.lit("-"), F.rint("value").cast("long") % 10).alias("k"))
    e = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "k"))), lambda x: x["k"]).alias("all"))
    return e.select("user_id", F.array_join(C.last_n(C.ordered_distinct(F.col("all")), 100), ",").alias("used"))


@query(f"select page_id, case when length(t) <= 500 then t else substring(t, 1, 500) end as preview from (select page_id, {tags_sql('html')} as t from pages)")
def chunk_preview(spark, read):
    return read("pages").select("page_id", F.substring(T.strip_tags("html"), 1, 500).alias("preview"))


_ = collapse_sql
