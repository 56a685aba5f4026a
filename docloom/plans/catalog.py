"""Registered queries over the catalog: the star schema stands in for documents, versions, chunks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import catalog as C
from docloom.plans.queries import query


@query("select p_partkey from part where p_name ilike '%ar%' or p_type ilike '%ar%'")
def catalog_ilike(spark, read):
    return read("part").where(C.matching(" ar ", "p_name", "p_type")).select("p_partkey")


@query("select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R')")
def catalog_exists(spark, read):
    links = read("lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return C.having(read("orders"), links, ["o_orderkey"]).select("o_orderkey")


@query("select o_orderkey, o_orderdate, c_name from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and c_mktsegment = 'BUILDING'")
def catalog_filter(spark, read):
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.where(C.equal_where_given(o_orderstatus="F", c_mktsegment="BUILDING", o_orderpriority=None)).select("o_orderkey", "o_orderdate", "c_name")


@query("select distinct l_partkey as code from lineitem where l_partkey not in (select p_partkey from part where p_size <= 25)")
def missing_ref(spark, read):
    active = read("part").where("p_size <= 25").select(F.col("p_partkey").alias("code"))
    return C.missing(read("lineitem").select(F.col("l_partkey").alias("code")), active, "code")


@query("select n_nationkey, n_name from nation where n_nationkey >= 5 union all select n_nationkey, 'new ' || n_name from nation where n_nationkey < 5 union all select n_nationkey + 100, 'added' from nation where n_nationkey < 3")
def ref_upsert(spark, read):
    old = read("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    new = old.where("n_nationkey < 5").withColumn("n_name", F.concat(F.lit("new "), F.col("n_name"))).unionByName(old.where("n_nationkey < 3").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lit("added").alias("n_name")))
    return C.upsert(old, new, ["n_nationkey"])


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_version(spark, read):
    return C.latest_by(read("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select l_orderkey, l_linenumber, least(l_quantity::bigint, 30) as processed, greatest(30 - l_quantity::bigint, 0) as remaining from lineitem")
def job_progress(spark, read):
    return read("lineitem").select("l_orderkey", "l_linenumber", *C.progress(F.lit(30).cast("long"), F.col("l_quantity").cast("long")))


_STATES = ["not_indexed", "failed", "chunked", "indexed", "published", "embedded"]
_EVENTS = ["review", "approve_chunks", "start_index", "job_success", "publish", "unpublish", "deindex", "delete"]
_PICK = lambda xs, e: "case " + " ".join(f"when {e} % {len(xs)} = {i} then '{x}'" for i, x in enumerate(xs)) + " end"
_MOVES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in C.TRANSITIONS)


@query(
    f"""with v as (select o_orderkey as version_id, {_PICK(_STATES, 'o_orderkey')} as rag_status, case when o_orderstatus = 'F' then 'done' else 'pending' end as ocr_status, 'approved' as review_status, o_orderkey % 7 = 0 as active_job from orders),
  e as (select o_orderkey + case when o_orderkey % 50 = 0 then 100000000 else 0 end as version_id, {_PICK(_EVENTS, 'o_custkey')} as event from orders), j as (select e.version_id, e.event, v.rag_status, m.n, case when v.rag_status is null then 'unknown_version' when m.n is null then 'wrong_status' when e.event in ('approve_chunks', 'start_index', 'publish') and ocr_status <> 'done' then 'not_approved' when e.event = 'deindex' and active_job then 'job_running' end as error
  from e left join v on v.version_id = e.version_id left join (values {_MOVES}) as m(s, e, n) on m.s = v.rag_status and m.e = e.event) select version_id, event, rag_status, case when error is null then n else rag_status end as next_status, error from j"""
)
def lifecycle(spark, read):
    o = read("orders")
    v = o.select(F.col("o_orderkey").alias("version_id"), F.expr(_PICK(_STATES, "o_orderkey")).alias("rag_status"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("ocr_status"), F.lit("approved").alias("review_status"), (F.col("o_orderkey") % 7 == 0).alias("active_job"))
    e = o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 50 == 0, 100000000).otherwise(0)).alias("version_id"), F.expr(_PICK(_EVENTS, "o_custkey")).alias("event"))
    return C.apply_events(v, e)


@query("select 'chunks' as kind, count(*) as n from lineitem where l_orderkey % 10 <> 3 union all select 'versions', count(*) from orders where o_orderkey % 10 <> 3")
def cascade_delete(spark, read):
    gone = read("orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("key"))
    left = C.cascade({"chunks": read("lineitem").withColumnRenamed("l_orderkey", "key"), "versions": read("orders").withColumnRenamed("o_orderkey", "key")}, gone, "key")
    return left["chunks"].agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), "n").unionByName(left["versions"].agg(F.count("*").alias("n")).select(F.lit("versions").alias("kind"), "n"))


@query("select o_orderkey, concat_ws(',', case when o_orderkey % 3 = 0 then 'status' end, case when o_orderkey % 4 = 0 then 'priority' end) as changed from orders where o_orderkey % 3 = 0 or o_orderkey % 4 = 0")
def meta_diff(spark, read):
    old = read("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("status")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("priority")).alias("priority"))
    return C.changed(old, new, "o_orderkey", ["status", "priority"]).select("o_orderkey", F.array_join("changed", ",").alias("changed"))


@query("""select event_id, case event_id % 7 when 0 then 'not_found' when 1 then 'not_found' when 2 then 'invalid' when 3 then 'invalid' when 4 then 'conflict' when 5 then 'conflict' else 'unavailable' end as code,
  case when event_id % 7 < 2 then 404 when event_id % 7 < 4 then 422 when event_id % 7 < 6 then 409 else 503 end as status, event_id % 7 = 6 and event_type in ('click', 'view') as retry from events""")
def err_class(spark, read):
    kind = F.element_at(F.array(*map(F.lit, ("not_found", "lookup", "value", "invalid", "conflict", "exists", "timeout"))), (F.col("event_id") % 7 + 1).cast("int"))
    phase = F.when(F.col("event_type") == "click", "store").when(F.col("event_type") == "view", "vectors").otherwise("review")
    return read("events").select("event_id", C.error_code(kind, phase).alias("e")).select("event_id", "e.*")


_STATE = "case o_orderkey % 3 when 0 then 'not_indexed' when 1 then 'published' else 'failed' end"


@query(f"""with v as (select o_orderkey as version_id, {_STATE} as rag, o_orderkey % 6 as k, o_orderkey % 11 = 0 as dateless, o_orderkey % 2 = 0 as owned, strftime(o_orderdate, '%Y-%m-%d') as issued from orders),
  r as (select *, k in (1, 4) and rag = 'published' as refused, not dateless or not owned as dated from v)
  select version_id, case when version_id % 97 = 0 then 'unknown_version' when refused then 'needs_deindex' when not dated then 'no_date' end as error, case when version_id % 97 <> 0 and refused then case k when 1 then 'title' else 'body' end else '' end as restricted,
  case when version_id % 97 = 0 or refused or not dated then '' else concat_ws(',', case when k = 1 then 'title' when k = 4 then 'body' when k = 2 then 'code' when k = 3 then 'domain' when k = 5 then 'audience' end, case when dateless then 'issued_date' end) end as changed,
  version_id % 97 <> 0 and not refused and dated and rag <> 'published' as whole, version_id % 97 <> 0 and not refused and dated and k in (3, 5) as sync_payload, case when version_id % 97 <> 0 and not refused and not dateless then issued end as recipients_date from r""")
def update_plan(spark, read):
    """Each order's version asks for one change by its number; some have no date left, some are unknown."""
    k, none = F.col("o_orderkey") % 6, F.lit(None).cast("string")
    issued = F.date_format("o_orderdate", "yyyy-MM-dd")
    base = {
        "title": F.col("o_orderpriority"), "type_id": F.lit(1), "departments": F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array().cast("array<string>")), "body": F.concat(F.lit("b"), "o_custkey"), "is_latest": F.lit(True),
        "domain": F.lit("d"), "audience": F.array(F.lit("x")), "code": F.col("o_orderstatus"), "issued_date": issued, "effective_date": none, "expiry_date": none, "validity_status": F.lit("unknown"),
    }
    asked = base | {
        "title": F.when(k == 1, "new").otherwise(base["title"]), "body": F.when(k == 4, "new").otherwise(F.concat(F.lit(" "), base["body"], F.lit(" "))), "departments": F.reverse(base["departments"]), "code": F.when(k == 2, "new").otherwise(base["code"]),
        "domain": F.when(k == 3, "new").otherwise("d"), "audience": F.when(k == 5, F.array(F.lit("y"))).otherwise(F.array(F.lit("x"))), "issued_date": F.when(F.col("o_orderkey") % 11 != 0, issued),
    }
    o = read("orders")
    current = o.where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("version_id"), F.expr(_STATE).alias("rag_status"), *[c.alias(n) for n, c in base.items()])
    p = C.update_plan(current, o.select(F.col("o_orderkey").alias("version_id"), *[c.alias(n) for n, c in asked.items()]))
    return p.withColumns({n: F.array_join(n, ",") for n in ("restricted", "changed")})


@query("select vec_id, case when vec_id % 10 = 0 then -1 else label end as label from embeddings union all select vec_id + 1000000, 7 from embeddings where vec_id % 100 = 0")
def vec_upsert(spark, read):
    old = read("embeddings").select("vec_id", "label")
    new = old.where("vec_id % 10 = 0").withColumn("label", F.lit(-1)).unionByName(old.where("vec_id % 100 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(7).alias("label")))
    return C.upsert(old, new, ["vec_id"])


