"""Registered query of a whole retrieval: documents are chunks of versions of ten, labels say which are published, items are questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.plans.queries import STOP, WORDS, query
from docloom.sources.shared import written

_CHUNK = "select d.doc_id as chunk_id, d.doc_id // 10 as version_key, d.doc_id % 10 as i, d.text as content, d.n_chars, l.quality = 1 and l.toxic = 0 as good from documents d left join (select doc_id, max(quality) as quality, min(toxic) as toxic from labels group by doc_id) l using (doc_id)"
_SQL = f"""every as ({_CHUNK}), good as (select version_key from every group by version_key having bool_or(good)),
  c as (select e.*, 'i' || (i - i % 2) as item, 'i' || (i // 2 - (i // 2) % 2) as parent_item, case when i % 3 <> 0 then 'p' || (i % 3) end as parent_chunk, i % 2 as split_index, case when i % 4 < 2 then 2 else 1 end as split_count from every e join good using (version_key) where i % 10 < 8),
  q as (select item_id as query_id, 0 as variant, text as query from benchmark union all select item_id, 1, text || ' about people' from benchmark),
  t as (select distinct query_id, variant, term from (select query_id, variant, unnest({WORDS.format('query')}) as term from q) where length(term) >= 2 and term not in ({STOP})),
  w as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest({WORDS.format('content')}) as term from c) group by term, chunk_id),
  sparse as (select query_id, variant, 1 as branch, chunk_id, row_number() over (partition by query_id, variant order by score desc, chunk_id) as rank from (select query_id, variant, chunk_id, round(0.1::double * sum(tf)::double, 12) as score from w join t using (term) group by all) qualify rank <= 30),
  dense as (select query_id, variant, 0 as branch, chunk_id, row_number() over (partition by query_id, variant order by score desc, chunk_id) as rank from (select q.query_id, q.variant, c.chunk_id, round(list_cosine_similarity(v.embedding::double[], x.embedding::double[]), 9) as score
    from c join embeddings v on v.vec_id = c.chunk_id, q join embeddings x on x.vec_id = q.query_id + q.variant) qualify rank <= 30),
  a as (select query_id, variant, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(branch * 1000 + rank) as f from (select * from dense union all select * from sparse) group by all),
  b as (select *, row_number() over (partition by query_id, variant order by score desc, f, chunk_id) as r from a qualify r <= 30),
  m as (select query_id, chunk_id, round(sum(1.0::double / (60 + r)), 12) as score, min(variant * 1000 + r) as f from b group by query_id, chunk_id),
  fused as (select *, row_number() over (partition by query_id order by score desc, f, chunk_id) as r from m qualify r <= 30),
  ranked as (select query_id, chunk_id, row_number() over (partition by query_id order by case when query_id % 3 > 0 then n_chars end desc nulls last, r) as r from fused join documents on doc_id = chunk_id),
  h as (select k.query_id, row_number() over (partition by k.query_id order by k.r, k.chunk_id) as rank, query_id % 2 = 0 as wants_list, c.* from ranked k join c using (chunk_id) where (chunk_id % 7 <> query_id % 7 or chunk_id >= 1400) qualify rank <= 5),
  found as (
    select query_id, rank as hit_rank, chunk_id, i, 'direct' as reason, 0 as kind, 0 as place from h
    union all select h.query_id, h.rank, c.chunk_id, c.i, 'parent', 1, row_number() over (partition by h.query_id, h.rank order by c.i) from h join c on c.version_key = h.version_key and c.i <> h.i and c.item = h.parent_item
    union all select h.query_id, h.rank, c.chunk_id, c.i, 'children', 2, row_number() over (partition by h.query_id, h.rank order by c.i) from h join c on c.version_key = h.version_key and c.i <> h.i and c.parent_item = h.item where h.wants_list
    union all select h.query_id, h.rank, c.chunk_id, c.i, 'siblings', 3, row_number() over (partition by h.query_id, h.rank order by c.i) from h join c on c.version_key = h.version_key and c.i <> h.i and c.parent_item = h.parent_item and (h.parent_chunk is null or c.parent_chunk = h.parent_chunk) where h.wants_list
    union all select h.query_id, h.rank, c.chunk_id, c.i, 'neighbors', 4, row_number() over (partition by h.query_id, h.rank order by c.i) from h join c on c.version_key = h.version_key and c.i <> h.i and c.item = h.item and abs(c.split_index - h.split_index) <= 1 where h.split_count > 1),
  o as (select *, row_number() over (partition by query_id order by kind > 0, hit_rank, kind, place) as n from found), d as (select * from o qualify row_number() over (partition by query_id, chunk_id order by n) = 1),
  e as (select *, row_number() over (partition by query_id order by n) as rank from d qualify rank <= 20)"""


def retrieved(read):
    i, version = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10)
    half = F.floor(i / 2)
    key = F.concat(F.lit("c"), i)
    chunks = read("documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit("child").alias("chunk_type"), F.when(i < 8, "indexed").otherwise("pending").alias("index_status"), version.alias("version_id"), F.concat(F.lit("v"), version).alias("version_key"), key.alias("chunk_key"), i.cast("int").alias("chunk_index"),
        F.col("text").alias("content"), (i + 1).cast("int").alias("page_start"), (i + 1).cast("int").alias("page_end"), F.array("lang").alias("heading_path"), F.lit(None).cast("long").alias("parent_chunk_id"), F.concat(F.lit("i"), i - i % 2).alias("item"),
        F.concat(F.lit("i"), half - half % 2).alias("parent_item"), F.when(i % 3 != 0, F.concat(F.lit("p"), i % 3)).alias("parent_chunk"), (i % 2).alias("split_index"), F.when(i % 4 < 2, 2).otherwise(1).alias("split_count"),
    )
    label = read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("toxic").alias("toxic"))
    good = read("documents").join(label, "doc_id", "left").groupBy(version.alias("version_id")).agg(F.bool_or((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    live = F.coalesce(F.col("good"), F.lit(False))
    versions = good.select(
        "version_id", F.col("version_id").alias("document_id"), F.concat(F.lit("v"), "version_id").alias("version_key"), F.when(live, "approved").otherwise("reviewing").alias("review_status"), F.lit("published").alias("rag_status"), F.lit(True).alias("is_latest"),
        F.lit("").alias("title"), F.concat(F.lit("s/file"), "version_id", F.lit(".pdf")).alias("source_path"), F.lit("").alias("canonical_markdown_path"), F.lit("").alias("source_url"),
    )
    documents = good.select(F.col("version_id").alias("document_id"), F.concat(F.lit("d"), "version_id").alias("document_key"), (F.col("version_id") % 2).cast("string").alias("type_id"), F.concat(F.lit("T"), "version_id").alias("title"))
    types = read("documents").sparkSession.createDataFrame([("0", "even")], "type_id string, type_name string")
    items = read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    questions = items.withColumn("wants_list", F.col("query_id") % 2 == 0)
    variants = items.select("query_id", F.lit(1).alias("position"), F.concat("query", F.lit(" about people")).alias("query"))
    vectors = read("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    embed = lambda q: q.join(read("embeddings"), F.col("query_id") + F.col("variant") == F.col("vec_id")).select("query_id", "variant", F.col("embedding").alias("vector"))
    # a reranker that fails for every third question
    scores = lambda hits: hits.where("query_id % 3 > 0").join(read("documents").select(F.col("doc_id").alias("chunk_id"), "n_chars"), "chunk_id").select("query_id", (F.col("rank") - 1).alias("place"), F.col("n_chars").cast("double").alias("score"))
    # an answer before used every seventh of the first 1,400 chunks
    used = read("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda x: x * 7 + F.col("item_id") % 7)).alias("chunk_id"))
    return R.retrieve(questions, variants, chunks, versions, documents, types, vectors, embed, T.search_terms("query"), scores, used, written=written)


@query(f"""with {_SQL} select query_id, row_number() over (partition by query_id order by e.rank, chunk_id) as rank, chunk_id, reason, 'd' || (chunk_id // 10) as document_key, 'c' || i as chunk_key, 'file' || (chunk_id // 10) || '.pdf, trang ' || (i + 1) as citation, 'T' || (chunk_id // 10) as title, case when (chunk_id // 10) % 2 = 0 then 'even' end as type_name
  from e where chunk_id % 7 <> query_id % 7 or chunk_id >= 1400""")
def retrieve_full(spark, read):
    return retrieved(read).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "reason", "document_key", "chunk_key", "citation", "title", "type_name")
