import math

from pyspark.sql import functions as F

from docloom.operators import ranking
from docloom.operators import retrieval as R


def nearest(vectors, queries, k):
    """Brute force; None last, a NaN first, ties by key."""
    out = set()
    for q, a in queries:
        if a is None or not any(a):
            continue
        hits = []
        for key, b in vectors:
            if b is None or None in b or not any(b):
                continue
            if len(a) != len(b):
                hits.append((math.inf, key, None))
                continue
            dot = na = nb = 0.0
            for x, y in zip(a, b, strict=True):
                dot, na, nb = dot + x * y, na + x * x, nb + y * y
            s = dot / (math.sqrt(nb) * math.sqrt(na))
            hits.append((-math.inf, key, "nan") if math.isnan(s) else (-round(s, 9), key, round(s, 9)))
        out |= {(q, key, s, n) for n, (_, key, s) in enumerate(sorted(hits, key=lambda h: h[:2])[:k], 1)}
    return out


def test_nearest_rows_without_pairs(spark, monkeypatch):
    vectors = [(k, [float(k * 7 % 11 - 5), float(k * 5 % 13), 1.0]) for k in range(400)] + [(k, [1.0, 2.0, 3.0]) for k in range(400, 500)]
    vectors += [(500, [0.0, 0.0, 0.0]), (501, None), (502, [1.0, None, 1.0]), (503, [1.0, 2.0]), (504, [float("nan"), 1.0, 1.0]), (505, [3.0, 4.0]), (506, [])]
    queries = [(1, [1.0, 2.0, 3.0]), (2, [-1.0, 0.5, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, 1.0]), (6, [5.0, 1.0, -2.0])]
    v, q = spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, query array<double>")
    monkeypatch.setattr(ranking, "CELLS", 64)
    for size in (64 << 20, 40):
        monkeypatch.setattr(ranking, "SLICE_BYTES", size)
        out = R.dense_topk(v, q, 20)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString() or size == 40
        got = {(r.query_id, r.vec_id, "nan" if r.score is not None and math.isnan(r.score) else r.score, r["rank"]) for r in out.collect()}
        assert got == nearest(vectors, queries, 20)
    assert R.dense_topk(v, q.limit(0), 3).count() == 0 and R.dense_topk(v.limit(0), q, 3).count() == 0
    named = R.dense_topk(v.select(F.concat(F.lit("é"), "vec_id").alias("name"), "embedding"), q.select(F.struct("query_id").alias("query_id"), "query"), 2, "name", digits=3)
    assert [(r.query_id.query_id, r.name) for r in named.where("query_id.query_id = 1").orderBy("rank").collect()] == [(1, "é504"), (1, "é400")]


def test_pairs_of_queries_and_chunks_are_summed_in_bounded_parts(spark, monkeypatch):
    from docloom.sources import shared

    monkeypatch.setattr(shared, "PART_ROWS", 10)
    chunks = spark.createDataFrame([(k // 2, f"apple w{k % 3} w{k % 3}") for k in range(40)], "chunk_id long, content string")
    terms = spark.createDataFrame([(q, t) for q in range(5) for t in ("apple", f"w{q}")], "query_id long, term string")
    index = R.postings(chunks, terms=terms)
    out = R.sparse_topk(index, terms, 3, chunks=chunks)
    assert ", 20), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, R.sparse_topk(index, terms, 3).collect()))


def test_words_are_matched_without_rows_for_pairs(spark, monkeypatch):
    from docloom.sources import shared

    index = [(f"w{t}", key, 1 + (t * key) % 3) for key in range(60) for t in range(9) if (t + key) % 4]
    terms = [((q, q % 2), f"w{t}") for q in range(7) for t in range(12) if (q * t) % 3 != 1 and q < 6 or t > 10] + [((8, 0), None)]
    want = set()
    for q in {q for q, _ in terms}:
        mine = {t for p, t in terms if p == q}
        n = {}
        for t, key, tf in index:
            n[key] = n.get(key, 0) + tf * (t in mine)
        want |= {(q, key, round(0.1 * s, 12), r) for r, (key, s) in enumerate(sorted(((k, s) for k, s in n.items() if s), key=lambda x: (-x[1], x[0]))[:5], 1)}
    monkeypatch.setattr(shared, "PART_ROWS", 50)
    monkeypatch.setattr(ranking, "CELLS", 16)
    i, t = spark.createDataFrame(index, "term string, chunk_id long, tf long"), spark.createDataFrame(terms, "query_id struct<q:long,v:long>, term string")
    for size in (64 << 20, 40):
        monkeypatch.setattr(ranking, "SLICE_BYTES", size)
        out = R.sparse_topk(i, t.unionByName(t), 5, chunks=i.select("chunk_id").distinct())
        assert {(tuple(r.query_id), r.chunk_id, r.score, r["rank"]) for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
