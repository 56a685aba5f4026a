import math

from docloom.operators import catalog as C
from docloom.operators import retrieval as R
from docloom.operators import store as K


def test_hydrated_fields_fall_back(spark):
    payload = "struct<chunk_key:string,parent_chunk_key:string,source_file:string,source_url:string,page_start:int,page_end:int,heading_path:array<string>,legal_unit_type:string,split_index:int,split_count:int>"
    hits = spark.createDataFrame([(1, 1, 10, 0.5, ("k10", "", "x/y.md", "", None, 4, ["H"], None, None, 2)), (1, 2, 11, None, ("", None, None, "pu", 7, None, [], "clause", 1, None)), (1, 3, 12, 0.1, None), (1, 4, None, 0.1, None)], f"query_id int, rank int, chunk_id int, score double, payload {payload}")
    chunks = spark.createDataFrame([(10, 1, 5, "c10", "ten", 3, 3, ["C"], "child", "indexed"), (11, 2, None, "c11", "eleven", 1, 9, ["D"], "child", "indexed"), (12, 3, None, "c12", "twelve", 1, 1, None, "child", "indexed"), (5, 1, None, "c5", "five", 1, 1, None, "parent", "indexed")], "chunk_id int, version_id int, parent_chunk_id int, chunk_key string, content string, page_start int, page_end int, heading_path array<string>, chunk_type string, index_status string")
    versions = spark.createDataFrame([(1, 1, "v1", "", "", "can/z.md", "", "approved", "published", True), (2, 1, "v2", "T2", "src/a.pdf", "", "vu", "approved", "published", True), (3, 1, "v3", "T3", "", "", "", "approved", "indexed", True)], "version_id int, document_id int, version_key string, title string, source_path string, canonical_markdown_path string, source_url string, review_status string, rag_status string, is_latest boolean")
    documents = spark.createDataFrame([(1, "d1", 9, "D1")], "document_id int, document_key string, type_id int, title string")
    types = spark.createDataFrame([(8, "other")], "type_id int, type_name string")
    got = {r.chunk_id: r for r in R.hydrate_fields(hits, chunks, versions, documents, types).collect()}
    a, b = got[10], got[11]
    assert got.keys() == {10, 11}
    assert (a.chunk_key, a.parent_chunk_key, a.page_start, a.page_end, a.title, a.source_file, a.source_url, a.heading_path, a.legal_unit_type, a.split_index, a.split_count, a.parent_content, a.type_name) == ("k10", "c5", 3, 4, "D1", "y.md", "", ["H"], "none", 0, 2, "five", None)
    assert (b.chunk_key, b.parent_chunk_key, b.page_start, b.page_end, b.title, b.source_file, b.source_url, b.heading_path, b.legal_unit_type, b.score) == ("c11", None, 7, 9, "T2", "a.pdf", "vu", ["D"], "clause", 0.0)


def test_reranker_answers_are_checked(spark):
    hits = spark.createDataFrame([(q, r, f"c{r}") for q in range(6) for r in (1, 2, 3)] + [(9, 1, "c1")], "query_id int, rank int, chunk_id string")
    answers = {0: [(0, 0.1), (1, 0.9), (2, 0.5)], 1: [(0, 0.1), (1, 0.9)], 2: [(0, 0.1), (1, 0.9), (1, 0.5)], 3: [(0, 0.1), (1, math.nan), (2, 0.5)], 4: [(0, 0.1), (1, 0.9), (3, 0.5)]}
    scores = spark.createDataFrame([(q, *x) for q, xs in answers.items() for x in xs] + [(9, 0, 0.1)], "query_id int, place int, score double")
    order = {}
    for r in R.apply_scores(hits, scores).orderBy("query_id", "rank").collect():
        order.setdefault(r.query_id, []).append(r.chunk_id)
    assert order.pop(0) == ["c2", "c3", "c1"] and order.pop(9) == ["c1"] and all(x == ["c1", "c2", "c3"] for x in order.values()) and len(order) == 5


def test_queries_of_a_search(spark):
    q = spark.createDataFrame([(1, " What  is  it "), (2, "  ")], "query_id int, query string")
    v = spark.createDataFrame([(1, 0, "what is IT"), (1, 1, "other  words"), (1, 2, ""), (2, 0, "x")], "query_id int, position int, query string")
    assert sorted(tuple(r) for r in R.search_queries(q, v).collect()) == [(1, 0, "What is it"), (1, 1, "other words")]
    assert R.candidate_k(5) == 30 and R.candidate_k(50) == 50


def test_guards_of_the_lifecycle(spark):
    base = dict(ocr_status="done", review_status="approved", title="t", n_bytes=5, n_chunk_errors=0, snapshot_changed=False, signature_equal=True, job_processing=True, active_job=False, minutes_since_update=0)
    cases = [("not_indexed", "review", {"title": " "}, "no_title"), ("not_indexed", "review", {"n_bytes": 0}, "wrong_size"), ("failed", "approve_chunks", {"n_chunk_errors": 1}, "chunk_errors"), ("not_indexed", "approve_chunks", {"snapshot_changed": True}, "snapshot_changed"), ("failed", "start_index", {"signature_equal": False}, "chunks_differ"), ("chunked", "job_success", {"job_processing": False}, "job_not_processing"), ("indexed", "deindex", {"active_job": True}, "job_running"), ("indexed", "deindex", {"active_job": True, "minutes_since_update": 9}, None), ("not_indexed", "start_index", {}, None), ("not_indexed", "publish", {}, "wrong_status")]
    rows = [dict(base, version_id=k, rag_status=s, **change) if not change else {**base, **change, "version_id": k, "rag_status": s} for k, (s, _, change, _) in enumerate(cases)]
    out = C.apply_events(spark.createDataFrame(rows), spark.createDataFrame([(k, c[1]) for k, c in enumerate(cases)], "version_id long, event string"))
    assert {r.version_id: r.error for r in out.collect()} == {k: c[3] for k, c in enumerate(cases)}


def test_drift_and_trace(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    assert {(r.found_dim, r.n) for r in K.vector_drift(v, 2).collect()} == {(1, 1), (-1, 1)} and K.vector_drift(v.where("id = 1"), 2).count() == 0
    assert K.schema_drift(v, {"id": "int", "embedding": "array<float>"}) == [] and len(K.schema_drift(v, {"id": "bigint", "x": "int"})) == 2
    hits = spark.createDataFrame([(1, k, f"c{k}", 0.1) for k in range(1, 9)], "query_id int, rank int, chunk_id string, score double")
    assert R.stage_trace({"dense": hits, "fused": hits}, 3).count() == 6
