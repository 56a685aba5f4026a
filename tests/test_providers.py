import json
import math
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.operators import providers as P

FAST = {"tries": 1, "wait": 0.0, "timeout": None}


def texts(spark, n=200):
    return spark.createDataFrame([(k, None if k == 7 else f"w{k} x{k % 5}") for k in range(n)], "chunk_key long, text string").repartition(3)


def failing(where):
    good = P.hashing_embedder(8)()

    def client(batch):
        if any(where in t.split() for t in batch):
            raise RuntimeError("no")
        return good(batch)

    return client


def test_only_the_request_that_fails_goes_to_the_fallback(spark):
    zeros = lambda: lambda batch: [[0.0] * 8 for _ in batch]
    e = {r.chunk_key: r for r in P.embedded(texts(spark), F.col("text"), lambda: failing("w42"), 8, fallback=zeros, **FAST).collect()}
    assert len(e) == 200 and [k for k, r in e.items() if r.answered_by != "provider"] == [42]
    assert e[42].vector == [0.0] * 8 and e[42].error == "RuntimeError: no" and e[7].vector == [0.0] * 8 and e[7].answered_by == "provider"
    assert all(abs(math.sqrt(sum(x * x for x in r.vector)) - 1) < 1e-9 for k, r in e.items() if k not in (7, 42))
    none = P.embedded(texts(spark), F.col("text"), lambda: failing("w42"), 8, **FAST).where("answered_by = 'none'").collect()
    assert [(r.chunk_key, r.vector) for r in none] == [(42, None)]


def test_wrong_sizes_retries_and_time_limits(spark):
    calls = []

    def shaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise OSError("away")
        return [1] * len(batch)

    assert P._asked(shaky, ["a", "b"], 3, 0.0, None, lambda x: None) == [1, 1] and calls == [2, 2, 2]
    with pytest.raises(OSError):
        P._asked(lambda b: (_ for _ in ()).throw(OSError("away")), ["a"], 2, 0.0, None, lambda x: None)
    with pytest.raises(ValueError, match="1 results for 2"):
        P._asked(lambda b: [1], ["a", "b"], 1, 0.0, None, lambda x: None)
    with pytest.raises(TimeoutError):
        P._asked(lambda b: time.sleep(2), ["a"], 1, 0.0, 0.05, lambda x: None)
    wrong = P.embedded(texts(spark, 5), F.col("text"), lambda: lambda batch: [[1.0] for _ in batch], 8, **FAST)
    assert {r.error for r in wrong.collect()} == {"ValueError: a vector of 8 numbers was asked for"}
    assert P.embedded(texts(spark, 5).limit(0), F.col("text"), lambda: failing("x"), 8, **FAST).count() == 0


def test_cached_texts_are_not_sent(spark):
    rows = texts(spark, 30)
    empty = spark.createDataFrame([], "chunk_key long, model string, text_hash string, vector array<double>")
    first, added = P.embedded_with_cache(rows, F.col("text"), empty, "m", lambda: failing("w3"), 8, **FAST)
    assert first.where("answered_by = 'provider'").count() == added.count() == 29  # w3 failed; its neighbours did not
    again, more = P.embedded_with_cache(rows, F.col("text"), added, "m", lambda: failing("w9"), 8, **FAST)
    assert {r.answered_by: r.n for r in again.groupBy("answered_by").agg(F.count("*").alias("n")).collect()} == {"cache": 29, "provider": 1} and more.count() == 1
    changed = rows.withColumn("text", F.concat("text", F.lit(" new")))
    assert P.embedded_with_cache(changed, F.col("text"), added, "m", lambda: failing("x"), 8, **FAST)[1].count() == 29  # the null text stays as it was
    assert P.embedded_with_cache(rows, F.col("text"), added, "other", lambda: failing("x"), 8, **FAST)[1].count() == 30


def test_reranking_keeps_the_order_where_the_answer_is_not_whole(spark):
    hits = spark.createDataFrame([(q, k, f"t {'x ' * k}", k * 10) for q in (1, 2, 3) for k in (1, 2, 3)], "query_id long, rank int, content string, doc_id int")
    questions = spark.createDataFrame([(1, "x"), (2, "few"), (3, "bad")], "query_id long, query string")

    def client(requests):
        out = []
        for r in map(json.loads, requests):
            if r["query"] == "bad":
                raise RuntimeError("down")
            out.append([float(len(t)) for t in r["texts"]][: 1 if r["query"] == "few" else None])
        return out

    got = P.reranked(hits, questions, lambda: client, **FAST).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 30), (1, 20), (1, 10), (2, 10), (2, 20), (2, 30), (3, 10), (3, 20), (3, 30)]
    overlap = P.reranked(hits.withColumn("content", F.when(F.col("rank") == 3, "x").otherwise("y")), questions, P.overlap_reranker, **FAST)
    assert overlap.where("query_id = 1 and rank = 1").first().doc_id == 30


def test_rewriting_and_answers(spark):
    questions = spark.createDataFrame([(1, "what is it"), (2, "fail"), (3, "other")], "query_id long, question string")

    def client(batch):
        if "fail" in batch:
            raise RuntimeError("no")
        return [json.dumps({"queries": [b.upper(), b + " please"]}) if b != "other" else "no object" for b in batch]

    got = Q.variants(P.rewritten(questions, lambda: client, **FAST)).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.query) for r in got] == [(1, "what is it"), (1, "what is it please"), (2, "fail"), (3, "other")]
    contexts = spark.createDataFrame([(1, "q", "c"), (2, "q", " "), (3, "q", None), (4, "bad", "c"), (5, "blank", "c")], "query_id long, query string, context string")
    says = {"q": {"status": "answered", "text": "yes", "used": ["k1"]}, "bad": {"status": "made up", "text": "x"}, "blank": {"status": "answered", "text": " "}}
    a = {r.query_id: (r.status, r.text, r.used) for r in P.answers(contexts, lambda: lambda batch: [json.dumps(says[json.loads(b)["query"]]) for b in batch], **FAST).collect()}
    none = ("insufficient_evidence", None, [])
    assert a == {1: ("answered", "yes", ["k1"]), 2: none, 3: none, 4: none, 5: none}
