"""Registered queries of the chunker, over documents made into Markdown by a rule on the line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chunking as K
from docloom.operators import structure as S
from docloom.plans.queries import query

#: Line endings inside a line, which a reader of Markdown would take for more lines.
_BREAKS = r"[\r\x0B\x0C\x1C-\x1F\x{85}\x{2028}\x{2029}\x{A0}]"
_LINE = r"trim(regexp_replace(regexp_replace(line, '{breaks}', ' '{g}), ' +', ' '{g}))"
_MARKED = """case pos % 8
  when 0 then case when pos % 16 = 0 then '<!-- page: ' || cast(1 + floor(pos / 16) as int) || ' -->' || chr(10) else '' end || repeat('#', cast(1 + (doc_id + pos) % 3 as int)) || ' ' || case when pos % 16 = 0 then 'Điều ' else 'h' end || pos
  when 2 then '1. x' || line when 4 then '- x' || line when 5 then '- x' || line
  when 6 then '```' || chr(10) || rtrim('x ' || line) || chr(10) || '```' else rtrim('x ' || line) end"""


def marked_documents(read):
    """(doc_id, text): every eighth line a heading, every sixteenth on a new page, between them an item with a paragraph, two bullets and code."""
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", _BREAKS, " "), " +", " ")))
    one = F.struct("pos", F.expr(_MARKED.replace("chr(10)", "char(10)")).alias("t"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("text"))


_W = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"
CHUNKS_SQL = f"""
l as (select doc_id, pos, {_LINE.format(breaks=_BREAKS, g=", 'g'")} as line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)),
m as (select doc_id, pos, pos // 8 as section, pos % 8 as k, 1 + pos // 16 as page, case when pos % 8 = 0 then 1 + (doc_id + pos) % 3 end as level,
  case pos % 8 when 0 then repeat('#', cast(1 + (doc_id + pos) % 3 as int)) || ' ' || case when pos % 16 = 0 then 'Điều ' else 'h' end || pos when 2 then '1. x' || line when 4 then '- x' || line when 5 then '- x' || line
    when 6 then '```' || chr(10) || rtrim('x ' || line) || chr(10) || '```' else rtrim('x ' || line) end as t from l),
r as (select *, max(case when level = 1 then pos end) {_W} as p1, max(case when level = 2 then pos end) {_W} as p2, max(case when level = 3 then pos end) {_W} as p3 from m),
title as (select *, list_transform(list_filter([p1, case when p2 > coalesce(p1, -1) then p2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then p3 end], lambda x: x is not null), lambda x: case when x % 16 = 0 then 'Điều ' else 'h' end || x) as path from r),
h as (select *, list_bool_or(list_transform(path, lambda x: x like 'Điều %')) as law, count(*) over (partition by doc_id, section) as n,
  max(case when k = 2 then t end) over s as item, max(case when k = 2 then pos end) over s as item_pos, max(case when k = 4 then t end) over s as first_bullet, max(case when k = 5 then t end) over s as second_bullet
  from title window s as (partition by doc_id, section)),
parents as (select doc_id, section, null as u, string_agg(t, chr(10) || chr(10) order by pos) as content, min(path) as path, min(page) as page from h group by doc_id, section),
u as (select *, case k when 3 then 2 when 5 then 4 else k end as u from h where k > 0 or n = 1 and pos % 16 = 0),
children as (select doc_id, section, u, case when u = 4 then string_agg(t, chr(10) order by pos) else string_agg(t, chr(10) || chr(10) order by pos) end as content, min(path) as path, min(page) as page,
  case u when 0 then 'heading' when 2 then 'numbered_item' when 4 then case when count(*) = 2 then 'bullet_group' else 'bullet_item' end when 6 then 'code' else 'paragraph' end as block_type,
  case when u = 2 then '1.' when u = 4 and count(*) = 1 then '-' end as item_marker, case when u = 2 then 1 when u = 4 and count(*) = 1 then 2 end as item_level,
  case when u = 2 then min(item) when u = 4 then min(item) || case when count(*) = 1 then '|' || min(first_bullet) else '' end when u > 4 then min(item) || '|' || min(second_bullet) else '' end as item_path,
  case when u = 2 or u = 4 and count(*) = 1 then 'item:' || lpad(min(pos)::varchar, 6, '0') end as item_key, case when u in (2, 4) then string_agg('item:' || lpad(pos::varchar, 6, '0'), ',' order by pos) filter (k <> 3) else '' end as item_keys,
  case when u = 4 then 'item:' || lpad(min(item_pos)::varchar, 6, '0') end as parent_item_key, case when u = 6 then 'code:' || lpad(min(pos)::varchar, 6, '0') end as code_key,
  case when u = 0 then 'article' when u = 2 and min(law) then 'clause' when u = 4 and min(law) then 'bullet' else 'none' end as legal_unit from u group by doc_id, section, u),
every as (select doc_id, section, u, content, path, page, block_type, item_marker, item_level, item_path, item_key, item_keys, parent_item_key, code_key, legal_unit from children
  union all select doc_id, section, null, content, path, page, null, null, null, null, null, null, null, null, null from parents),
keyed as (select *, doc_id || '::p::' || lpad(sum(case when u is null then 1 else 0 end) over w ::varchar, 4, '0') as p, doc_id || '::c::' || lpad(sum(case when u is null then 0 else 1 end) over w ::varchar, 4, '0') as c, row_number() over w - 1 as chunk_index
  from every window w as (partition by doc_id order by section, u is not null, u rows between unbounded preceding and current row))"""


@query(f"""with {CHUNKS_SQL} select doc_id, case when u is null then p else c end as chunk_key, case when u is not null then p end as parent_chunk_key, case when u is null then 'parent' else 'child' end as chunk_type, chunk_index::bigint as chunk_index, content,
  array_to_string(path, '>') as path, page::bigint as page_start, page::bigint as page_end, len(string_split_regex(trim(content), '\\s+'))::bigint as token_count, block_type, item_marker, item_level::bigint as item_level, item_path, item_key, item_keys, parent_item_key, cast(null as varchar) as table_key, code_key, legal_unit,
  case when u is not null then 0 end::bigint as split_index, case when u is not null then 1 end::bigint as split_count from keyed""")
def chunk_document(spark, read):
    c = K.chunk_documents(marked_documents(read), size=1_000_000)
    long = lambda n: F.col(n).cast("long").alias(n.split(".")[-1])
    joined = lambda n, by: F.array_join(f"metadata.{n}", by)
    return c.select(
        "doc_id", "chunk_key", "parent_chunk_key", "chunk_type", long("chunk_index"), "content", F.array_join("heading_path", ">").alias("path"), long("page_start"), long("page_end"), long("token_count"),
        "metadata.block_type", "metadata.item_marker", long("metadata.item_level"), joined("item_path", "|").alias("item_path"), F.col("metadata.logical_item_key").alias("item_key"), joined("logical_item_keys", ",").alias("item_keys"),
        "metadata.parent_item_key", F.col("metadata.logical_table_key").alias("table_key"), F.col("metadata.logical_code_key").alias("code_key"), F.col("metadata.legal_unit_type").alias("legal_unit"), long("metadata.split_index"), long("metadata.split_count"),
    )


@query(f"with {CHUNKS_SQL} select doc_id, 'warning' as severity, 'context_only_parent' as code, page::bigint as page, t as content, array_to_string(path, '>') as path, 1.0::double as confidence from h where n = 1 and pos % 16 = 8")
def chunk_warnings(spark, read):
    r = K.chunk_reports(marked_documents(read), size=1_000_000)
    return r.select("doc_id", "severity", "code", F.col("page").cast("long").alias("page"), "content", F.array_join("heading_path", ">").alias("path"), "confidence")


_WORDS = "length(text) - length(replace(text, ' ', '')) + 1"


@query(f"""with w as (select doc_id, {_WORDS} as n from documents), s as (select doc_id, n, case when n <= 120 then 1 else 1 + cast(ceil((n - 120) / 110.0) as bigint) end as parts from w)
  select doc_id, i as split_index, parts as split_count, case when parts = 1 then 10 * n - 1 when i < parts - 1 then 1199 else 10 * (n - 110 * (parts - 1)) - 1 end as length from s, unnest(range(parts)) as t(i)""")
def chunk_splits(spark, read):
    """Paragraphs of as many words of nine letters as a document has spaces: pieces of 120 words at the production sizes, each sharing ten with the next."""
    words = F.array_join(F.array_repeat(F.lit("abcdefghi"), F.expr(f"cast({_WORDS} as int)")), " ")
    docs = read("documents").select("doc_id", F.concat(F.lit("<!-- page: 1 -->\n## words\n"), words).alias("text"))
    c = K.chunk_documents(docs).where("chunk_type = 'child'")
    return c.select("doc_id", *[F.col(f"metadata.{n}").cast("long").alias(n) for n in ("split_index", "split_count")], F.length("content").cast("long").alias("length"))


_BLOCK_SQL = """select doc_id, pos as source_order, case k when 0 then 'heading' when 2 then 'numbered_item' when 4 then 'bullet_item' when 5 then 'bullet_item' when 6 then 'code' else 'paragraph' end as block_type, page::bigint as page, t as content, array_to_string(path, '>') as path,
  case k when 2 then 1 when 4 then 2 when 5 then 2 end::bigint as item_level, case k when 2 then '1.' when 4 then '-' when 5 then '-' end as item_marker, case when k in (2, 4, 5) then 'item:' || lpad(pos::varchar, 6, '0') when k = 6 then 'code:' || lpad(pos::varchar, 6, '0') end as item_key,
  case when k in (4, 5) then 'item:' || lpad(item_pos::varchar, 6, '0') end as parent_item_key, case when k = 0 then case when pos % 16 = 0 then 'article' else 'none' end when k = 2 and law then 'clause' when k in (4, 5) and law then 'bullet' else 'none' end as legal_unit from h"""


def _blocks(read):
    b = S.blocks(S.pages(marked_documents(read)))
    return b.select("doc_id", F.col("source_order").cast("long").alias("source_order"), "block_type", F.col("page_start").cast("long").alias("page"), "content", F.array_join("heading_path", ">").alias("path"), F.col("item_level").cast("long").alias("item_level"), "item_marker", "item_key", "parent_item_key", "legal_unit")


@query(f"with {CHUNKS_SQL} {_BLOCK_SQL}")
def blocks(spark, read):
    return _blocks(read)


@query(f"with {CHUNKS_SQL}, b as ({_BLOCK_SQL}) select doc_id, source_order, item_key, parent_item_key, item_level, legal_unit from b where item_level is not null")
def item_tree(spark, read):
    return _blocks(read).where("item_level is not null").select("doc_id", "source_order", "item_key", "parent_item_key", "item_level", "legal_unit")


@query("""with l as (select doc_id, len(string_split(text, chr(10))) as n from documents), p as (select doc_id, n, unnest(range(n)) as pos from l)
  select doc_id, pos as source_order, 'numbered_item' as block_type, 'item_level_jump' as problem, 1::bigint as page_start from p where pos % 3 = 1 union all select doc_id, n, 'code', 'unclosed_code_fence', 1 from l""")
def parse_reports(spark, read):
    """A heading, an item of the second level below it, an item of the first; at the end a fence that is never closed."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "# h").when(i % 3 == 1, "1.1. x").otherwise("2. x"), i.cast("string")))
    docs = read("documents").select("doc_id", F.concat(F.lit("<!-- page: 1 -->\n"), F.array_join(rows, "\n"), F.lit("\n```\nopen")).alias("text"))
    b = S.blocks(S.pages(docs)).where("problem is not null")
    return b.select("doc_id", F.col("source_order").cast("long").alias("source_order"), "block_type", "problem", F.col("page_start").cast("long").alias("page_start"))


@query(f"""with {CHUNKS_SQL}, v as (select *, case when k = 3 then 2 else k end as w from h where k > 0 or n = 1)
  select doc_id, section + 1 as section, case w when 0 then 'heading' when 2 then 'numbered_item' when 4 then 'bullet_item' when 5 then 'bullet_item' when 6 then 'code' else 'paragraph' end as block_type, min(page)::bigint as page,
  case when w in (2, 4, 5) then 'item:' || lpad(min(pos)::varchar, 6, '0') when w = 6 then 'code:' || lpad(min(pos)::varchar, 6, '0') end as item_key, case when w in (4, 5) then 'item:' || lpad(min(item_pos)::varchar, 6, '0') end as parent_item_key,
  case when w > 0 or min(pos) % 16 = 0 then string_agg(t, chr(10) || chr(10) order by pos) end as content, case when w = 0 and min(pos) % 16 = 8 then 'context_only_parent' end as warning from v group by doc_id, section, w""")
def child_units(spark, read):
    u = S.child_units(S.blocks(S.pages(marked_documents(read))))
    return u.select("doc_id", F.col("section").cast("long").alias("section"), "block_type", F.col("page_start").cast("long").alias("page"), "item_key", "parent_item_key", "content", "warning")
