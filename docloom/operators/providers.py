"""Calls of outside models (embedding, reranking, rewriting, answering) from inside Spark tasks.

A provider is a function without arguments that makes a client; it is called once for each task, so a connection lasts as long
as its partition. A client takes a list of requests and gives a list of results of the same length. ``called`` sends batches
with retries, a time limit and a check of the answer. A batch that keeps failing is halved until single requests fail: those
alone go to the fallback, and their error stays in a column. So neither the size of a batch nor its neighbours decide a result.

Tasks that run again call again: results are to be written before they are used twice. Null requests count as empty text. An
empty table calls nobody.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import retrieval as R

Client = Callable[[list], list]
BATCH, TRIES, WAIT_S, TIMEOUT_S = 64, 3, 0.5, 8.0


def _asked(client: Client, requests: list, tries: int, wait: float, timeout: float | None, fits: Callable[[Any], str | None]) -> list:
    """The results of one batch; raises what the last try raised."""
    for left in range(tries - 1, -1, -1):
        try:
            if timeout:
                pool = ThreadPoolExecutor(1)
                try:
                    got = pool.submit(client, requests).result(timeout)
                except TooLate:
                    raise TimeoutError(f"no answer in {timeout:g} s") from None
                finally:
                    pool.shutdown(wait=False, cancel_futures=True)
            else:
                got = client(requests)
            if len(got) != len(requests):
                raise ValueError(f"{len(got)} results for {len(requests)} requests")
            if wrong := next((w for x in got if (w := fits(x))), None):
                raise ValueError(wrong)
            return got
        except Exception:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    return []


def _settled(client: Client, requests: list, *how) -> Iterator[tuple[Any, str | None]]:
    """(result, error) of each request; a failing batch is halved."""
    try:
        yield from ((x, None) for x in _asked(client, requests, *how))
    except Exception as e:
        if len(requests) == 1:
            yield None, f"{type(e).__name__}: {e}"
        else:
            middle = len(requests) // 2
            yield from _settled(client, requests[:middle], *how)
            yield from _settled(client, requests[middle:], *how)


def called(
    rows: DataFrame, request: Column, provider: Callable[[], Client], result: pa.DataType, kind: str, fallback: Callable[[], Client] | None = None, fits: Callable[[Any], str | None] = lambda x: None,
    batch: int = BATCH, tries: int = TRIES, wait: float = WAIT_S, timeout: float | None = TIMEOUT_S,
) -> DataFrame:
    """``rows`` with result (of SQL type ``kind``), answered_by ('provider', 'fallback' or 'none') and error.

    ``fits`` says what is wrong with a result, or null. The fallback gets single requests and is not tried again.
    """
    names = rows.columns
    how = (tries, wait, timeout, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = spare = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                client = client or provider()
                requests = ["" if x is None else x for x in part.column(len(names)).to_pylist()]
                results, by, errors = [], [], []
                for request_, (got, error) in zip(requests, _settled(client, requests, *how), strict=True):
                    who = "provider"
                    if error is not None:
                        who = "none"
                        if fallback:
                            spare = spare or fallback()
                            got, who = spare([request_])[0], "fallback"
                    results.append(got)
                    by.append(who)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(results, result), pa.array(by), pa.array(errors, pa.string())], [*names, "result", "answered_by", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(*names, request.alias("_request")).mapInArrow(run, f"{schema}, result {kind}, answered_by string, error string")


# ---- embedding


def hashing_embedder(size: int) -> Callable[[], Client]:
    """A provider without a model: words between spaces counted by their hash, of length one."""

    def one(text: str) -> list[float]:
        out = [0.0] * size
        for w in text.split(" "):
            if w:
                out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size] += 1
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    return lambda: lambda texts: [one(t) for t in texts]


def embedded(rows: DataFrame, text: Column, provider: Callable[[], Client], size: int, **how) -> DataFrame:
    """``rows`` with vector, answered_by and error; an answer of another size or with a value that is no number is refused."""

    def fits(v: Any) -> str | None:
        return None if len(v) == size and all(math.isfinite(x) for x in v) else f"a vector of {size} numbers was asked for"

    return called(rows, text, provider, pa.list_(pa.float64()), "array<double>", fits=fits, **how).withColumnRenamed("result", "vector")


def embedded_with_cache(rows: DataFrame, text: Column, cache: DataFrame, model: str, provider: Callable[[], Client], size: int, key: str = "chunk_key", **how) -> tuple[DataFrame, DataFrame]:
    """(rows with vector and answered_by, new cache rows): only texts whose (key, model, sha256, size) the cache lacks are sent.

    Write the second frame before the first is used again: it is what was paid for. Fallback vectors are not cached.
    """
    known = cache.where((F.col("model") == model) & (F.size("vector") == size)).select(key, "text_hash", F.col("vector").alias("known")).dropDuplicates([key, "text_hash"])
    probed = rows.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256)).join(known, [key, "text_hash"], "left")
    new = embedded(probed.where("known is null").drop("known"), text, provider, size, **how)
    old = probed.where("known is not null").select(*rows.columns, "text_hash", F.col("known").alias("vector"), F.lit("cache").alias("answered_by"), F.lit(None).cast("string").alias("error"))
    added = new.where("answered_by = 'provider'").select(key, F.lit(model).alias("model"), "text_hash", "vector")
    return old.unionByName(new.select(*old.columns)).drop("text_hash"), added


# ---- reranking


def overlap_reranker() -> Client:
    """A reranker without a model: the share of a question's words that a text has."""

    def one(request: str) -> list[float]:
        r = json.loads(request)
        asked = {w for w in r["query"].split(" ") if w}
        return [len(asked & set(t.split(" "))) / max(1, len(asked)) for t in r["texts"]]

    return lambda requests: [one(r) for r in requests]


def reranked(hits: DataFrame, questions: DataFrame, provider: Callable[[], Client], text: str = "content", **how) -> DataFrame:
    """``hits`` (query_id, rank, ...) of questions (query_id, query) in the order of a model, one request for a question's hits together.

    A request is JSON {"query", "texts"} with the texts in rank order, its result one score a text. Where the model fails
    or scores too few, too many or no numbers, the order stays (see ``retrieval.apply_scores``).
    """
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(text, F.lit("")).alias("t")))).alias("h")).join(questions.select("query_id", "query"), "query_id")
    request = F.to_json(F.struct(F.coalesce("query", F.lit("")).alias("query"), F.transform("h", lambda x: x["t"]).alias("texts")))
    got = called(grouped.select("query_id", request.alias("r")), F.col("r"), provider, pa.list_(pa.float64()), "array<double>", **how)
    scores = got.where("result is not null").select("query_id", F.posexplode("result").alias("place", "score"))
    return R.apply_scores(hits, scores)


# ---- rewriting and answering


def rewritten(questions: DataFrame, provider: Callable[[], Client], **how) -> DataFrame:
    """(query_id, question, answer, answered_by, error) for ``questions.variants``: a model's JSON, or nothing where it failed, so that the question alone is searched."""
    fits = lambda x: None if isinstance(x, str) and "{" in x else "no JSON object"
    got = called(questions.select("query_id", "question"), F.col("question"), provider, pa.string(), "string", fits=fits, **how)
    return got.withColumnRenamed("result", "answer")


STATUSES = ["answered", "insufficient_evidence", "nothing_further"]


def answers(contexts: DataFrame, provider: Callable[[], Client], **how) -> DataFrame:
    """(query_id, status, text, used, error) from (query_id, query, context): a model's JSON {"status", "text", "used"}.

    Without a context nobody is asked; a status that is not listed, or an answered one without text, counts as insufficient evidence.
    """
    empty = F.trim(F.coalesce("context", F.lit(""))) == ""
    request = F.to_json(F.struct("query", "context"))
    got = called(contexts.where(~empty).select("query_id", request.alias("r")), F.col("r"), provider, pa.string(), "string", **how)
    a = F.from_json("result", "status string, text string, used array<string>")
    good = a["status"].isin(STATUSES) & ((a["status"] != "answered") | (F.trim(F.coalesce(a["text"], F.lit(""))) != ""))
    status = F.when(F.coalesce(good, F.lit(False)), a["status"]).otherwise("insufficient_evidence")
    out = got.select("query_id", status.alias("status"), F.when(status == "answered", a["text"]).alias("text"), F.coalesce(F.when(status == "answered", a["used"]), F.array().cast("array<string>")).alias("used"), "error")
    none = contexts.where(empty).select("query_id", F.lit("insufficient_evidence").alias("status"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("used"), F.lit(None).cast("string").alias("error"))
    return out.unionByName(none)
