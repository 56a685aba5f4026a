"""Registered queries of the provider calls, with offline providers that are true functions of their requests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.operators import providers as P
from docloom.plans.queries import DENSE_SQL, FUSE_SQL, SPARSE_SQL, corpus, fused_hits, query
from docloom.sources.shared import written

SIZE = 16
_FAILS = "strlen(text) % 97 = 0"
_EMBED_SQL = f"""w as (select doc_id, text, unnest(string_split(text, ' ')) as w from documents), c as (select doc_id, ('0x' || substring(md5(w), 1, 8))::bigint % {SIZE} as k, count(*)::double as n from w where w <> '' and not {_FAILS} group by all),
  v as (select doc_id, sum(n * n) as s, sum(n * (k + 1)) as f, count(*) as used from c group by doc_id)"""


def _failing_embedder():
    """Fails for a batch with a text of so many bytes, as an outside model may for one request."""
    good = P.hashing_embedder(SIZE)()

    def client(texts: list) -> list:
        if any(len(t.encode()) % 97 == 0 for t in texts):
            raise RuntimeError("refused")
        return good(texts)

    return client


@query(f"""with {_EMBED_SQL} select d.doc_id, case when {_FAILS} then 'fallback' else 'provider' end as answered_by, case when {_FAILS} then 'RuntimeError: refused' end as error, case when {_FAILS} then 1 else coalesce(used, 0) end as n_used, round(case when {_FAILS} then 1.0::double else coalesce(f / sqrt(s), 0.0::double) end, 6) as weighted
  from documents d left join v using (doc_id)""")
def embed_provider(spark, read):
    """All texts in batches; a batch with a text that the model refuses is halved until that text alone goes to the fallback."""
    fallback = lambda: lambda texts: [[1.0] + [0.0] * (SIZE - 1) for _ in texts]
    e = P.embedded(read("documents").select("doc_id", "text"), F.col("text"), lambda: _failing_embedder(), SIZE, fallback=fallback, tries=1, wait=0.0, timeout=None)
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("doc_id", "answered_by", "error", F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_used"), F.round(weighted, 6).alias("weighted"))


def _scores(requests: list) -> list:
    """Longer texts first; too few scores where a question has an odd number of characters."""
    out = []
    for r in map(json.loads, requests):
        n = [float(len(t)) for t in r["texts"]]
        out.append(n[:-1] if len(r["query"]) % 2 else n)
    return out


@query(f"""with {SPARSE_SQL}, {DENSE_SQL}, {FUSE_SQL}, t as (select f.*, length(d.text) as n, length(b.text) as q, count(*) over (partition by query_id) as hits from fused f join documents d using (doc_id) join benchmark b on b.item_id = f.query_id)
  select query_id, doc_id, row_number() over (partition by query_id order by case when q % 2 = 0 and hits > 1 then n end desc nulls last, rank) as rank from t""")
def rerank_provider(spark, read):
    """A model's order where its answer is whole, else the order before."""
    hits = written(fused_hits(read), "fused").join(corpus(read).select("doc_id", F.col("text").alias("content")), "doc_id")
    questions = read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return P.reranked(hits, questions, lambda: _scores, tries=1, timeout=None).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""select item_id as query_id, case when trim(text) = '' or length(text) % 3 = 1 then 'insufficient_evidence' when length(text) % 3 = 2 then 'nothing_further' else 'answered' end as status, case when length(text) % 3 = 0 then 'on ' || item_id end as text from benchmark""")
def answers_provider(spark, read):
    def client(requests: list) -> list:
        out = []
        for r in map(json.loads, requests):
            n = len(r["context"]) % 3
            out.append(json.dumps({"status": ["answered", "made up", "nothing_further"][n], "text": f"on {r['query']}", "used": []}))
        return out

    c = read("benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("query"), F.col("text").alias("context"))
    return P.answers(c, lambda: client, tries=1, timeout=None).select("query_id", "status", "text")


@query("""with b as (select item_id, md5(text) as h from benchmark) select item_id as query_id, 1 as position, h as query from b union all select item_id, 2, h || ' please' from b where item_id % 5 > 1""")
def rewrite_provider(spark, read):
    """A model's rewrites beside the question; where it fails or gives no JSON the question alone."""

    def client(questions: list) -> list:
        out = []
        for q in questions:
            if q.startswith("0 "):
                raise RuntimeError("refused")
            out.append("no object" if q.startswith("1 ") else json.dumps({"queries": [q[2:].upper(), q[2:] + " please"]}))
        return out

    b = read("benchmark").select(F.col("item_id").alias("query_id"), F.concat((F.col("item_id") % 5).cast("string"), F.lit(" "), F.md5("text")).alias("question"))
    got = P.rewritten(b, lambda: client, tries=1, timeout=None)
    return Q.variants(got.withColumn("question", F.substring("question", 3, 32)))
