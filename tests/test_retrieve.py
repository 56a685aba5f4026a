from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval as R


def test_a_whole_retrieval(spark):
    chunk = "chunk_id long, chunk_type string, index_status string, version_id long, version_key string, chunk_key string, chunk_index int, content string, page_start int, page_end int, heading_path array<string>, parent_chunk_id long, item string, parent_item string, parent_chunk string, split_index int, split_count int"
    row = lambda i, v, text, item, parent, kind="child", status="indexed": (i, kind, status, v, f"v{v}", f"c{i}", i, text, i, i, ["H"], 100, item, parent, None, 0, 1)
    rows = [row(1, 1, "apple pie recipe", "i1", None), row(2, 1, "apple tart", "i2", "i1"), row(3, 1, "nothing here", "i3", "i1"), row(4, 2, "apple pie hidden", "i4", None), row(5, 1, "apple pie pending", "i5", None, status="pending"), row(100, 1, "parent text", None, None, "parent", None)]
    chunks = spark.createDataFrame(rows, chunk)
    versions = spark.createDataFrame([(k, k, f"v{k}", "approved", "published" if k == 1 else "indexed", True, "", "s/f.pdf", "", "") for k in (1, 2)], "version_id long, document_id long, version_key string, review_status string, rag_status string, is_latest boolean, title string, source_path string, canonical_markdown_path string, source_url string")
    documents = spark.createDataFrame([(1, "d1", "t", "Doc"), (2, "d2", "t", "Doc 2")], "document_id long, document_key string, type_id string, title string")
    types = spark.createDataFrame([("t", "Type")], "type_id string, type_name string")
    questions = spark.createDataFrame([(1, "apple pie", True), (2, " ", False), (3, "unheard", False)], "query_id long, query string, wants_list boolean")
    variants = spark.createDataFrame([(1, 1, "APPLE  pie"), (1, 2, "tart")], "query_id long, position int, query string")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in (1, 2, 3, 4)], "chunk_id long, embedding array<double>")
    embed = lambda q: q.where("query_id = 1").select("query_id", "variant", F.array(F.lit(1.0), F.lit(1.0)).alias("vector"))
    none = lambda fused: fused.limit(0).select("query_id", F.lit(0).alias("place"), F.lit(0.0).alias("score"))
    used = spark.createDataFrame([], "query_id long, chunk_id long")
    out = R.retrieve(questions, variants, chunks, versions, documents, types, vectors, embed, T.search_terms("query"), none, used, top_k=1)
    got = [(r.query_id, r["rank"], r.chunk_id, r.reason, r.citation, r.title) for r in out.orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, "direct", "f.pdf, trang 1", "Doc"), (1, 2, 2, "children", "f.pdf, trang 2", "Doc"), (1, 3, 3, "children", "f.pdf, trang 3", "Doc")] or got[0][2] == 2
    context = R.answer_contexts(out).collect()
    assert len(context) == 1 and context[0].context.count("parent text") == 1 and "apple pie recipe" in context[0].context
    again = R.retrieve(questions, variants, chunks, versions, documents, types, vectors, embed, T.search_terms("query"), none, out.select("query_id", "chunk_id").where("rank = 1"), top_k=1)
    assert out.where("rank = 1").first().chunk_id not in {r.chunk_id for r in again.collect()}


def test_expansion_is_one_join_and_keeps_the_first_find_of_each_chunk(spark, monkeypatch):
    import random

    from docloom.sources import shared

    pick = random.Random(7).choice
    items = [None, "a", "b", "c"]
    chunks = [(f"v{v}", f"c{v}-{i}", i, pick(items), pick(items), pick([None, "p"]), pick([0, 1, 2]), pick([1, 2])) for v in range(4) for i in range(12)]
    hits = [(q, n, *c, q % 2 == 0) for q in range(30) for n, c in enumerate(random.Random(q).sample(chunks, 3), 1)]
    names = "version_key string, chunk_key string, chunk_index int, item string, parent_item string, parent_chunk string, split_index int, split_count int"
    want = []
    for q in range(30):
        found = []
        for _, rank, v, key, index, item, parent, chunk, at, count, lists in (h for h in hits if h[0] == q):
            found.append((0, rank, 0, index, v, key, "direct"))
            for w, k, i, it, pa, ch, a, _ in chunks:
                if w == v and k != key:
                    tests = (it == parent is not None, lists and pa == item is not None, lists and pa == parent is not None and chunk in (None, ch), count > 1 and it == item is not None and abs(a - at) <= 1)
                    found += [(1, rank, n, i, w, k, reason) for n, (fine, reason) in enumerate(zip(tests, R.REASONS[1:], strict=True), 1) if fine]
        seen = {}
        for f in sorted(found):
            seen.setdefault(f[4:6], f[6])
        want += [(q, n, *key, reason) for n, (key, reason) in enumerate(list(seen.items())[:5], 1)]
    monkeypatch.setattr(shared, "PART_ROWS", 10)
    out = R.expand(spark.createDataFrame(hits, f"query_id int, rank int, {names}, wants_list boolean"), spark.createDataFrame(chunks, names), 5)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "RepartitionByExpression [version_key" in plan and "RepartitionByExpression [query_id" in plan
