"""Registered queries over maintenance, metadata, answers and pages: each calls the library over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import catalog as C
from docloom.operators import retrieval as R
from docloom.operators import store as K
from docloom.plans.queries import query

# ---- vectors


@query("with g as (select unnest([1, 2, 3, 999]) as k) select 'removed' as side, k::bigint as version_key, (select count(*) from embeddings where label = k) as n from g union all select 'kept', label::bigint, count(*) from embeddings where label not in (select k from g) group by label")
def vec_delete(spark, read):
    points = read("embeddings").withColumn("version_key", F.col("label").cast("long"))
    kept, removed = K.delete_points(points, spark.createDataFrame([(1,), (2,), (3,), (999,)], "version_key long"))
    return removed.select(F.lit("removed").alias("side"), "version_key", F.col("removed").alias("n")).unionByName(kept.groupBy("version_key").agg(F.count("*").alias("n")).withColumn("side", F.lit("kept")))


@query("select doc_id, case when source like '%1' then 'indexed' else 'published' end as rag_status, case when source like '%1' then 'sinh_vien,all' else lang end as audience, coalesce(source like '%1', false) as audience_student from documents")
def payload_patch(spark, read):
    points = read("documents").select("doc_id", "source", F.lit("published").alias("rag_status"), F.array("lang").alias("audience"), F.lit(False).alias("audience_student"))
    patch = points.where("source like '%1'").select("source", F.lit("indexed").alias("rag_status"), F.array(F.lit("sinh_vien"), F.lit("all")).alias("audience")).distinct()
    return K.patch_payload(points, patch, "source", ["rag_status", "audience"]).select("doc_id", "rag_status", F.array_join("audience", ",").alias("audience"), "audience_student")


_PAYLOAD = {"document_key": "source", "version_key": "'v' || doc_id", "title": "'T'", "source_file": "case when doc_id % 2 = 0 then 'c/' || doc_id else 's/' || doc_id end", "source_url": "case when doc_id % 3 = 0 then null else 'u' end", "audience": "case when doc_id % 4 = 0 then 'sinh_vien' else lang end", "audience_student": "doc_id % 4 = 0", "is_latest": "true", "chunk_index": "doc_id::int", "postgres_chunk_id": "doc_id::bigint", "split_count": "case when doc_id % 5 = 0 then 3 else 1 end"}
_DEFAULTS = {None: "null", True: "true", False: "false"}


def _payload_sql() -> str:
    cell = lambda name, kind, default: _PAYLOAD.get(name) or ("''" if default == [] else f"'{default}'" if isinstance(default, str) else _DEFAULTS.get(default, str(default)) if not isinstance(default, int) or isinstance(default, bool) else str(default))
    kinds = {"string": "varchar", "array<string>": "varchar", "boolean": "boolean", "int": "int", "bigint": "bigint"}
    return "select doc_id, " + ", ".join(f"cast({cell(n, k, d)} as {kinds[k]}) as {n}" for n, k, d in K.PAYLOAD) + " from documents"


@query(_payload_sql())
def payload(spark, read):
    i = F.col("doc_id")
    chunks = read("documents").select(
        "doc_id", F.col("source").alias("document_key"), F.concat(F.lit("v"), i).alias("version_key"), F.lit("T").alias("title"), F.when(i % 2 == 0, F.concat(F.lit("c/"), i)).otherwise("").alias("canonical_markdown_path"),
        F.concat(F.lit("s/"), i).alias("source_path"), F.when(i % 3 == 0, "").otherwise("u").alias("source_url"), F.array(F.when(i % 4 == 0, "sinh_vien").otherwise(F.col("lang"))).alias("audience"), F.lit(True).alias("is_latest"),
        i.cast("int").alias("chunk_index"), i.alias("postgres_chunk_id"), F.when(i % 5 == 0, 3).alias("split_count"),
    )
    out = K.payload(chunks).withColumn("doc_id", F.col("postgres_chunk_id"))
    return out.withColumns({n: F.array_join(n, ",") for n, k, _ in K.PAYLOAD if k.startswith("array")})


@query("select len(embedding)::int as found_dim, count(*) as n from embeddings where len(embedding) <> 3 group by 1")
def vec_drift(spark, read):
    return K.vector_drift(read("embeddings"), 3)


@query("""with c as (select doc_id, text, doc_id % 4 = 0 and doc_id % 6 <> 0 and doc_id % 10 <> 0 as hit from documents) select doc_id, hit, case when hit then 1 else length(text) end::double as v from c""")
def embed_cache(spark, read):
    d, i = read("documents").select("doc_id", F.col("doc_id").alias("chunk_key"), F.col("text").alias("content")), F.col("chunk_key")
    one = F.lit(1.0).cast("float")
    cache = d.where("doc_id % 2 = 0").select("chunk_key", F.when(i % 6 == 0, "stale").otherwise(F.sha2("content", 256)).alias("content_hash"), F.when(i % 4 == 0, "m1").otherwise("m0").alias("model"), F.when(i % 10 == 0, F.array(one)).otherwise(F.array(one, one)).alias("embedding"))
    out = K.embed_with_cache(d, cache, "m1", 2, lambda c: F.array(F.length(c).cast("float"), one))
    return out.select(i.alias("doc_id"), "hit", F.col("vector")[0].cast("double").alias("v"))


# ---- chunks

_NEW = "n as (select conv_id, turn, role from conversations where conv_id % 2 = 0), bad as (select distinct conv_id from n where role <> 'user' and (conv_id, turn - 1) not in (select (conv_id, turn) from n where role = 'user')), g as (select *, row_number() over (order by conv_id, role <> 'user', turn) + 999999 as id from n where conv_id not in (select conv_id from bad))"


def _chunk_versions(read):
    c = read("conversations").select(F.col("conv_id").alias("version_key"), F.concat(F.lit("c"), F.col("turn")).alias("chunk_key"), F.when(F.col("role") != "user", F.concat(F.lit("c"), F.col("turn") - 1)).alias("parent_chunk_key"), F.col("turn").alias("chunk_index"))
    old = c.withColumn("id", F.col("chunk_index").cast("long")).withColumn("parent_id", F.lit(None).cast("long"))
    return K.replace_chunks(old, c.where("version_key % 2 = 0"), 1_000_000)


@query(f"with {_NEW} select g.conv_id as version_key, 'c' || g.turn as chunk_key, g.id, p.id as parent_id from g left join g p on p.conv_id = g.conv_id and p.turn = g.turn - 1 and g.role <> 'user' union all select conv_id, 'c' || turn, turn, null from conversations where conv_id not in (select conv_id from g)")
def chunks_replace(spark, read):
    return _chunk_versions(read)[0].select("version_key", "chunk_key", "id", "parent_id")


@query(f"with {_NEW} select conv_id as version_key, 'c' || turn as chunk_key, 'c' || (turn - 1) as parent_chunk_key from n where role <> 'user' and (conv_id, turn - 1) not in (select (conv_id, turn) from n where role = 'user')")
def chunk_parent_errors(spark, read):
    return _chunk_versions(read)[1]


@query("select conv_id, turn, role, 'approved' as side from conversations where turn % 3 = 0 union all select conv_id, turn, role || '?', 'generated' from conversations where turn % 3 = 0")
def approval_diff(spark, read):
    a = read("conversations")
    return K.snapshot_diff(a, a.withColumn("role", F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit("?"))).otherwise(F.col("role"))), ["conv_id", "turn", "role"])


def _kinds(read):
    x = read("lineitem").withColumn("chunk_type", F.when(F.col("l_linenumber") == 1, "parent").otherwise("child")).withColumn("severity", F.when(F.col("l_returnflag") == "R", "warning").when(F.col("l_returnflag") == "A", "error"))
    return K.chunk_report(x, "l_orderkey")


@query("select l_orderkey, count(*) filter (l_returnflag = 'R') as warnings, count(*) filter (l_returnflag = 'A') as errors, count(*) filter (l_linenumber = 1) as parents, count(*) filter (l_linenumber <> 1) as children, count(*) as total from lineitem group by l_orderkey")
def chunk_stats(spark, read):
    return _kinds(read)


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def chunk_count(spark, read):
    return _kinds(read).select("l_orderkey", F.col("total").alias("n"))


@query("select l_orderkey, l_linenumber, concat_ws(',', case when l_linenumber % 4 <> 0 and l_linenumber % 5 <> 0 and l_linenumber > l_quantity then 'page_order' end, case when l_linenumber = 1 and l_tax > 0.05 then 'parent_has_parent' end, case when l_linenumber > 1 and l_tax <= 0.05 then 'child_without_parent' end) as broken from lineitem")
def chunk_contract(spark, read):
    n = F.col("l_linenumber")
    x = read("lineitem").select("l_orderkey", "l_linenumber", F.when(n % 4 != 0, n).alias("page_start"), F.when(n % 5 != 0, F.col("l_quantity")).alias("page_end"), F.when(n == 1, "parent").otherwise("child").alias("chunk_type"), F.when(F.col("l_tax") > 0.05, "k").alias("parent_chunk_key"))
    return x.select("l_orderkey", "l_linenumber", F.array_join(K.contract_errors(x), ",").alias("broken"))


# ---- links


@query("""with w as (select page_id % 100 as v, page_id, url, 'url-' || sha256(url) as k from pages), t as (select v, url, count(*) as n from w group by all having count(*) > 1), g as (select * from w where v not in (select v from t))
  select 'link' as kind, v::varchar as owner, k as name, page_id as n from g union all select 'link', 'old', 'url-' || sha256(url), min(page_id) from pages where page_id % 3 = 0 group by url
  union all select 'asset', '', 'url-' || sha256(url), 1 from (select url from pages where page_id % 3 = 0 union select url from g) union all select 'duplicate', v::varchar, url, n from t""")
def asset_upsert(spark, read):
    p = read("pages")
    old = p.where("page_id % 3 = 0").groupBy("url").agg(F.min("page_id").alias("display_order"))
    assets = old.select(F.concat(F.lit("url-"), F.sha2("url", 256)).alias("asset_key"), "url")
    links = old.select(F.lit("old").alias("version_key"), F.concat(F.lit("url-"), F.sha2("url", 256)).alias("asset_key"), "display_order")
    wanted = p.select((F.col("page_id") % 100).cast("string").alias("version_key"), F.col("page_id").alias("position"), "url")
    assets, links, twice = K.replace_assets(assets, links, wanted)
    row = lambda df, kind, owner, name, n: df.select(F.lit(kind).alias("kind"), owner.alias("owner"), F.col(name).alias("name"), n.cast("long").alias("n"))
    return row(links, "link", F.col("version_key"), "asset_key", F.col("display_order")).unionByName(row(assets, "asset", F.lit(""), "asset_key", F.lit(1))).unionByName(row(twice, "duplicate", F.col("version_key"), "url", F.col("n")))


@query("""with bad as (select distinct l_orderkey from lineitem where l_suppkey % 5 = 0), r as (select l_orderkey, l_suppkey, min(l_linenumber) as p from lineitem where l_orderkey not in (select l_orderkey from bad) group by all)
  select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by p, l_suppkey) as position, case when p % 2 = 0 then '2000-01-0' || p else strftime(o_orderdate, '%Y-%m-%d') end as effective from r join orders on o_orderkey = l_orderkey
  union all select o_orderkey, 7, 1, 'old' from orders where o_orderkey in (select l_orderkey from bad) union all select distinct -1 - l_orderkey, 7, 1, 'old' from lineitem""")
def recipients(spark, read):
    """Orders replace their recipients; one that names an inactive code keeps what it had, as do those not asked about."""
    n = F.col("l_linenumber")
    wanted = read("lineitem").select(F.col("l_orderkey").alias("version_key"), F.col("l_suppkey").alias("code"), n.alias("position"), F.when(n % 2 == 0, F.concat(F.lit("2000-01-0"), n)).alias("effective_date"))
    versions = read("orders").select(F.col("o_orderkey").alias("version_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_date"))
    departments = read("lineitem").select(F.col("l_suppkey").alias("code")).distinct().withColumn("is_active", F.col("code") % 5 != 0)
    had = versions.select("version_key").unionByName(read("lineitem").select((-1 - F.col("l_orderkey")).alias("version_key")).distinct())
    old = had.select("version_key", F.lit(7).cast("long").alias("code"), F.lit(1).alias("position"), F.lit("old").alias("effective_date"))
    out = K.replace_recipients(old, wanted, versions, departments)[0]
    return out.select(F.col("version_key").alias("l_orderkey"), F.col("code").alias("l_suppkey"), F.col("position").cast("long").alias("position"), F.col("effective_date").alias("effective"))


@query("select n_nationkey, n_name from nation where n_regionkey <> 2 and n_nationkey % 7 <> 0")
def ref_active(spark, read):
    return K.active_codes(read("nation").withColumn("is_active", F.when(F.col("n_nationkey") % 7 != 0, F.col("n_regionkey") != 2))).select("n_nationkey", "n_name")


@query("with m as (select o_custkey, max(o_orderkey) as m from orders where o_orderstatus = 'P' group by o_custkey) select o_orderkey, m is null or m = o_orderkey as is_latest from orders left join m using (o_custkey)")
def demote_latest(spark, read):
    v = read("orders").withColumn("is_latest", F.lit(True))
    return K.demote_others(v, v.where("o_orderstatus = 'P'"), "o_custkey", "o_orderkey").select("o_orderkey", "is_latest")


# ---- jobs


@query("select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id")
def last_job(spark, read):
    return K.latest_job(read("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("select user_id, bool_or(event_type = 'purchase' and event_id % 3 = 0) as approved from events group by user_id")
def chunks_approved(spark, read):
    e = read("events").withColumn("job_type", F.when(F.col("event_type") == "purchase", "ingestion")).withColumn("step", F.when(F.col("event_id") % 3 == 0, "chunks_approved"))
    return K.chunks_approved(e, "user_id")


@query("select event_id, event_id % 3 = 0 or (event_id % 3 = 1 and ts < (select max(ts) from events) - interval 5 minutes) as retryable from events")
def job_retryable(spark, read):
    e = read("events").withColumn("status", F.when(F.col("event_id") % 3 == 0, "failed").when(F.col("event_id") % 3 == 1, "processing").otherwise("done"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return e.join(now).select("event_id", K.retryable(F.col("status"), F.col("ts"), F.col("now")).alias("retryable"))


@query("""with g as (select o_orderkey, o_custkey from orders where o_orderstatus = 'F'), l as (select o_orderkey, o_custkey from orders where o_orderstatus <> 'F')
  select 'version' as kind, o_orderkey as id from l union all select 'document', c_custkey from customer where c_custkey not in (select o_custkey from g where o_custkey not in (select o_custkey from l))""")
def orphan_doc(spark, read):
    v = read("orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), "o_orderstatus")
    docs, left = C.removed_with_orphans(read("customer").select(F.col("c_custkey").alias("document_id")), v, v.where("o_orderstatus = 'F'"))
    return left.select(F.lit("version").alias("kind"), F.col("version_id").alias("id")).unionByName(docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")))


# ---- metadata

_FIELDS = "map('document_key', array(source), 'title', array(if(doc_id % 3 = 0, ' ', 't')), 'is_latest', array(if(doc_id % 4 = 0, 'maybe', 'true')), 'checksum', array(if(doc_id % 5 = 0, 'zz', sha2(coalesce(text, ''), 256))), 'audience', array(lang), 'rag_status', array('published'), 'ocr_status', array(if(doc_id % 2 = 0, 'done', 'pending')), 'issued_date', array(if(doc_id % 7 = 0, '1/2/2020', '2020-01-02')), 'extra', array('x'))"
_ABSENT = [f for f in K.CORE if f not in ("document_key", "title", "is_latest", "checksum", "audience", "rag_status", "ocr_status")]
_ERRORS = "concat_ws(',', " + ", ".join(f"'missing:{f}'" for f in _ABSENT) + """, case when lang not in ('en', 'de') then 'enum:audience' end, case when doc_id % 4 = 0 then 'boolean:is_latest' end, case when doc_id % 2 <> 0 then 'enum:ocr_status' end, case when doc_id % 5 = 0 then 'sha256:checksum' end,
  case when doc_id % 7 = 0 then 'date:issued_date' end, case when doc_id % 2 <> 0 then 'published:ocr_status' end, 'published:review_status')"""


def _validated(read):
    v = K.validation(F.expr(_FIELDS), {"ocr_status": ["done", "failed"]}, ["en", "de"])
    return read("documents").select("doc_id", v.alias("v"))


@query(f"select doc_id, {_ERRORS} as errors, concat_ws(',', 'unknown:extra', case when doc_id % 3 = 0 then 'review:title' end) as warnings from documents")
def meta_validate(spark, read):
    return _validated(read).select("doc_id", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"))


@query(f"select sum(length(e) - length(replace(e, ',', '')) + 1)::bigint as errors, count(*) as files from (select {_ERRORS} as e from documents)")
def meta_totals(spark, read):
    return _validated(read).agg(F.sum(F.size("v.errors")).alias("errors"), F.count_if(F.size("v.errors") > 0).alias("files"))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then 'given' end, nullif(source, ''), 'x') as title, coalesce(case when doc_id % 2 = 0 then lang end, 'inferred') as domain from documents")
def meta_build(spark, read):
    i = F.col("doc_id")
    d = read("documents").select("doc_id", F.when(i % 3 == 0, " given ").otherwise("").alias("arg_title"), F.col("source").alias("old_title"), F.lit("x").alias("new_title"), F.lit(None).cast("string").alias("arg_domain"), F.when(i % 2 == 0, F.col("lang")).otherwise(" ").alias("old_domain"), F.lit("inferred").alias("new_domain"))
    return d.select("doc_id", *K.merged(["title", "domain"], "arg_", "old_", "new_"))


@query("select doc_id, coalesce(case when doc_id % 2 = 0 then 'db-' || source end, lang) as domain from documents")
def meta_overlay(spark, read):
    return read("documents").select("doc_id", K.overlaid(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("db-"), F.col("source")))).alias("domain"))


@query("select c_custkey, regexp_full_match(c_mktsegment, '[A-Za-z0-9_][A-Za-z0-9_/-]*') as department_ok, trim(c_mktsegment) as audience from customer")
def meta_rules(spark, read):
    s = F.col("c_mktsegment")
    return read("customer").select("c_custkey", K.department_ok(s).alias("department_ok"), F.array_join(K.cleaned_list(F.array(F.concat(F.lit(" "), s), F.lit(" "), s)), ",").alias("audience"))


@query("""select o_orderkey as version_id, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, ''), c_name, '') as title, case when o_orderkey % 2 = 0 then 'en' else 'vi' end as language, strftime(o_orderdate, '%Y-%m-%d') as issued,
  strftime(o_orderdate, '%Y-%m-%d') as effective, o_orderstatus = 'F' as is_published, o_orderstatus in ('F', 'O') as is_searchable from orders left join customer on o_custkey = c_custkey""")
def catalog_summary(spark, read):
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "indexed").otherwise("chunked")
    return K.summary(o.select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("c_name").alias("document_title"), F.when(F.col("o_orderkey") % 2 == 0, '{"language": "en"}').alias("meta"), F.col("o_orderdate").alias("issued_date"), F.lit(None).cast("date").alias("effective_date"), status.alias("rag_status")))


@query("""select o_orderkey, coalesce(parts, '') as parts, coalesce(jobs, '') as jobs from orders left join (select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey::varchar) as parts from lineitem group by l_orderkey) on o_orderkey = l_orderkey
  left join (select user_id, string_agg(event_type, ',' order by event_id) as jobs from events group by user_id) on o_orderkey = user_id""")
def catalog_detail(spark, read):
    parts = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("place"), F.col("l_partkey").cast("string").alias("value"))
    jobs = read("events").select(F.col("user_id").alias("o_orderkey"), F.col("event_id").alias("place"), F.col("event_type").alias("value"))
    return K.with_related(read("orders").select("o_orderkey"), {"parts": parts, "jobs": jobs}, "o_orderkey").select("o_orderkey", F.array_join("parts", ",").alias("parts"), F.array_join("jobs", ",").alias("jobs"))


@query("select page_id, case when page_id % 2 = 0 then '/d/06_Processing/01_OCR_Output/PDF_g' || (page_id % 5) || '/f' || page_id || '_llp.md' else '/d/06_Processing/01_OCR_Output/DOCX_g' || (page_id % 5) || '/sub/f' || page_id || '_llp.md' end as path from pages")
def ocr_path(spark, read):
    i = F.col("page_id")
    path = F.concat(F.lit("/d/02_Attachments/"), F.when(i % 2 == 0, "PDF").otherwise("DOCX"), F.lit("/g"), i % 5, F.lit("/sub/f"), i, F.lit(".x"))
    return read("pages").select("page_id", K.ocr_output_path(path).alias("path"))


# ---- answers

_RANKED = "select l_orderkey as query_id, l_suppkey % 3 as d, case when l_linenumber % 2 = 0 then l_linenumber end as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rank from lineitem"


@query(f"select query_id, 'd' || d as document_key, p as page_start, rank as first_rank, row_number() over (partition by query_id order by rank) as rank from (select query_id, d, p, min(rank) as rank from ({_RANKED}) group by query_id, d, p)")
def citations(spark, read):
    rank = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)").cast("long")
    page = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber"))
    hits = read("lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("d"), F.col("l_suppkey") % 3).alias("document_key"), F.lit("v").alias("version_key"), page.alias("page_start"), page.alias("page_end"), rank.alias("rank"), rank.alias("first_rank"))
    return R.distinct_citations(hits).select("query_id", "document_key", "page_start", "first_rank", F.col("rank").cast("long").alias("rank"))


_BEFORE = "ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"


@query(f"select conv_id, turn, last_value(case when turn % 4 = 0 then 't' || turn end {_BEFORE} as before_topic, last_value(case when role = 'user' then case when turn % 6 = 0 then 'own' end else 'd' || turn end {_BEFORE} as before_document_key, last_value(case when role <> 'user' then 'v' || turn end {_BEFORE} as before_version_key from conversations")
def conv_context(spark, read):
    t, user = F.col("turn"), F.col("role") == "user"
    cited = F.when(~user, F.array(F.struct(F.concat(F.lit("d"), t).alias("document_key"), F.concat(F.lit("v"), t).alias("version_key"))))
    turns = read("conversations").select("conv_id", "turn", F.when(t % 4 == 0, F.concat(F.lit("t"), t)).alias("topic"), F.when(user & (t % 6 == 0), "own").alias("document_key"), F.lit(None).cast("string").alias("version_key"), cited.alias("citations"))
    return R.carried_over(turns)


@query("select doc_id, case when doc_id % 5 = 0 then 'no_search' when doc_id % 5 = 1 and n_chars < 500 then 'nothing_further' when n_chars < 500 then 'insufficient_evidence' else 'answered' end as status from documents")
def answer_status(spark, read):
    i = F.col("doc_id")
    return read("documents").select("doc_id", R.answer_status(i % 5 != 0, F.floor(F.col("n_chars") / 500), i % 5 == 1).alias("status"))


@query("select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def latency_p95(spark, read):
    return R.latency(read("events"), ["event_type"], "value")


@query("select o_orderkey as query_id, round(coalesce(s, case when o_orderstatus = 'F' then 0.0 else 1.0 end)::double, 9) as citation_precision from orders left join (select l_orderkey, avg(case when l_suppkey % 3 = 0 then 1.0 else 0.0 end) as s from (select distinct l_orderkey, l_suppkey from lineitem where l_linenumber > 3) group by l_orderkey) on o_orderkey = l_orderkey")
def cite_precision(spark, read):
    cases = read("orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderstatus") == "F").alias("answerable"))
    cited = read("lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("document_key"))
    return R.citation_scores(cases, cited, cited.where("document_key % 3 = 0"))


@query("select conv_id as query_id, 'c' || turn % 4 as chunk_key, min(turn) as place, 'text ' || turn % 4 as content from conversations where turn % 4 <> 3 group by conv_id, turn % 4")
def context_keys(spark, read):
    keys = read("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.concat(F.lit("c"), F.col("turn") % 4).alias("chunk_key"))
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}") for k in range(3)], "chunk_key string, content string")
    return R.context_of_keys(keys, chunks)


_LISTS = "select user_id as query_id, (event_id % 2)::int as variant, ((event_id // 2) % 2)::int as branch, event_id % 23 as chunk_id, row_number() over (partition by user_id, event_id % 2, (event_id // 2) % 2 order by event_id) as rank from events"


@query(f"""with l as (select * from ({_LISTS}) where rank <= 30), a as (select query_id, variant, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(branch * 1000 + rank) as f from l group by all),
  b as (select *, row_number() over (partition by query_id, variant order by score desc, f, chunk_id) as r from a qualify r <= 30), c as (select query_id, chunk_id, round(sum(1.0::double / (60 + r)), 12) as score, min(variant * 1000 + r) as f from b group by all),
  d as (select *, row_number() over (partition by query_id order by score desc, f, chunk_id) as r from c qualify r <= 30), n as (select query_id, count(*) as n from d group by query_id),
  e as (select d.query_id, chunk_id, row_number() over (partition by d.query_id order by case when n > 1 and d.query_id % 2 = 0 then (chunk_id * 7) % 11 else 0 end desc, d.r) as r from d join n using (query_id))
  select query_id, chunk_id, row_number() over (partition by query_id order by r, chunk_id) as rank from e where chunk_id % 5 <> 0 qualify rank <= 5""")
def search_hits(spark, read):
    place = F.expr("row_number() over (partition by user_id, event_id % 2, floor(event_id / 2) % 2 order by event_id)")
    lists = read("events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 2).alias("variant"), (F.floor(F.col("event_id") / 2) % 2).alias("branch"), (F.col("event_id") % 23).alias("chunk_id"), place.alias("rank"))
    # a reranker that answers for even queries, and not for all hits of the others
    scores = lambda hits: hits.where("query_id % 2 = 0 or rank > 1").select("query_id", (F.col("rank") - 1).alias("place"), ((F.col("chunk_id") * 7) % 11).cast("double").alias("score"))
    used = lists.where("chunk_id % 5 = 0").select("query_id", "chunk_id").distinct()
    return R.search(lists, scores, used, 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


# ---- pages


@query("select conv_id, min(turn) as first, max(turn) as last from conversations where turn between 1 and 3 group by conv_id")
def page_range(spark, read):
    return R.page_range(R.page_slice(read("conversations"), 1, 3, "turn"), "conv_id", "turn")


@query("select conv_id, turn, text from conversations where turn between 1 and 2")
def page_slice(spark, read):
    return R.page_slice(read("conversations"), 1, 2, "turn").select("conv_id", "turn", "text")


@query("""select conv_id, 'blank' as mode, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id union all select conv_id, 'none', string_agg(text, '' order by turn) from conversations group by conv_id
  union all select conv_id, 'html-comment', string_agg('<!-- page: ' || turn || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn) from conversations group by conv_id""")
def pages_join(spark, read):
    out = None
    for mode in ("blank", "none", "html-comment"):
        part = R.joined_pages(read("conversations"), mode, "conv_id", "turn", "text").withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("select conv_id, turn, coalesce(case when turn % 2 = 0 then turn end, row_number() over (partition by conv_id order by turn)) as page_number from conversations")
def page_number_default(spark, read):
    rows = read("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("turn")).cast("long").alias("page_number"))
    return R.numbered_pages(rows, "conv_id", "turn", "page_number")


@query("select l_orderkey, l_linenumber from lineitem where (l_linenumber % 4 = 0 or l_linenumber <= 3) and (l_linenumber % 5 = 0 or l_linenumber + 2 >= 2)")
def page_overlap(spark, read):
    n = F.col("l_linenumber")
    return read("lineitem").where(R.overlaps(F.when(n % 4 != 0, n), F.when(n % 5 != 0, n + 2), 2, 3)).select("l_orderkey", "l_linenumber")
