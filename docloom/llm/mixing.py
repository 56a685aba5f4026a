"""Mixing documents to target weights by soft membership.

A classifier fitted on the labelled table gives each document posteriors over the domains high (quality 1), low
(quality 0) and toxic (toxic 1). Document rates r >= 0 are found whose expected domain token totals
E_k = sum of r * tokens * posterior_k meet the targets T_k, by projected gradient on

    sum_k (E_k - T_k)^2 / S_k  +  ridge * sum of (tokens / N) * (r - 1)^2,     S_k = E_k at r = 1, N = all tokens.

Every step is one aggregation of K sums over all documents; the driver holds those K numbers and the steps' K
coefficients, never a document. A document's rate is the fold of all steps so far over its own posteriors, clipped
to the least and most rate after each, so no table is rewritten between steps. With the step length 1 / (2 + 2 *
ridge) the objective cannot rise. It stops after ``steps`` = 30, or when no total moves by 1e-9 of N.

The classifier: softmax regression over 15 figures of a text (shares of character kinds, word statistics, and each
domain's strongest word n-gram log-odds), fitted on at most ``most_labelled`` = 4,000 labelled documents of at most
1 MiB each and ``most_bytes`` (32 MiB) in all, taken in hash order of doc_id.

Tokens are words between white space. Nulls and empty texts have none, and the rate of their posteriors. A doc_id
with several labels takes the largest toxic, then the least quality. Without labels all documents belong to high.
Rows that repeat a doc_id each give a row. A domain without any token cannot be met and is left out.
Targets that the clipped rates cannot reach are missed; ``totals`` reports target and achieved tokens of each domain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ASCII_SPACE, fitted, id_text, spaced, stored, text_chunks, unused
from docloom.llm.toxicity import GRAM_SLOTS, document_counts, tokens, tokens_of_many

DOMAINS = ("high", "low", "toxic")
WEIGHTS = {"high": 0.86, "low": 0.12, "toxic": 0.02}
_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 48:58] = _KINDS[1, 65:91] = _KINDS[2, 97:123] = _KINDS[3, 128:] = _KINDS[4, [9, 10, 13, 32]] = True
_KINDS[5] = ~_KINDS[:5].any(axis=0)


def figures(data: np.ndarray, offs: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(white-space words, 15 figures) of each text."""
    n = len(offs) - 1
    text, begins = spaced(data, offs)
    space = ASCII_SPACE[text]
    start = ~space & np.append(True, space[:-1])
    line = text == 10
    count = lambda flags: np.diff(np.append(0, np.cumsum(flags))[begins]).astype(np.float64)
    n_words = count(start)
    size = np.maximum(np.diff(offs), 1)
    columns = [count(_KINDS[k][text]) / size for k in range(6)]
    number, first, slots = tokens(data, offs)
    seen = np.diff(first)
    doc = np.repeat(np.arange(n), seen)
    distinct = np.bincount(np.unique(doc * np.int64(len(slots) + 1) + number) // (len(slots) + 1), minlength=n)
    columns += [np.log1p(n_words), distinct / np.maximum(seen, 1), size / np.maximum(n_words, 1), np.log1p(count(line)), n_words / np.maximum(count(line), 1) / 100, np.minimum(seen / np.maximum(n_words, 1), 3)]
    for k in range(len(DOMAINS)):
        best = np.full(n, -5.0)
        if len(doc):
            np.maximum.at(best, doc, odds[k][slots[:, 1:]].max(axis=1)[number])
        columns.append(best)
    return n_words.astype(np.int64), np.stack(columns, axis=1)


class Classifier:
    """Softmax regression over ``figures``."""

    def __init__(self, texts: list[bytes], domain: np.ndarray, steps: int = 400):
        self.odds = np.zeros((len(DOMAINS), GRAM_SLOTS), np.float32)
        self.known = np.unique(domain)
        if len(self.known) < 2:
            return
        number, first, slots = tokens_of_many(texts)
        for k in self.known:
            up, down = document_counts(first, number, slots, domain == k)
            odds = np.log((up + 0.3) / ((domain == k).sum() + 1)) - np.log((down + 0.3) / ((domain != k).sum() + 1))
            self.odds[k] = np.where(up + down >= 3, odds * (up + down) / (up + down + 3.0), 0)
        del number, first, slots
        x = np.concatenate([figures(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), self.odds)[1] for part in (texts[i : i + 200] for i in range(0, len(texts), 200))])
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.append((x - self.mean) / self.spread, np.ones((len(x), 1)), axis=1)
        y = (domain[:, None] == np.arange(len(DOMAINS))).astype(float)
        self.w, m1, m2 = np.zeros((x.shape[1], len(DOMAINS))), 0.0, 0.0
        for t in range(1, steps + 1):
            g = x.T @ (self._softmax(x @ self.w) - y) / len(x) + 1e-4 * self.w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            self.w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        off = np.full(len(DOMAINS), -np.inf)
        off[self.known] = 0
        z = np.exp(z + off - (z + off).max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posteriors(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, x = figures(data, offs, self.odds)
        if len(self.known) < 2:
            p = np.zeros((len(n), len(DOMAINS)))
            p[:, self.known[0] if len(self.known) else 0] = 1
            return n, p
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        return n, self._softmax(np.append(x, np.ones((len(x), 1)), axis=1) @ self.w)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4_000, most_bytes: int = 32 << 20) -> Classifier:
    """The classifier, trained in one task on a bounded sample of the labelled documents."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.expr("max(case when toxic > 0 then 2 when quality > 0 then 0 else 1 end)").alias("label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # at most so many rows: may be broadcast
    return fitted(id_text(docs).join(F.broadcast(sample), "doc_id"), Classifier, most_bytes)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p): each document's words and posteriors in the order of DOMAINS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offs in text_chunks(batches):
            n, p = shared.value.posteriors(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(p.ravel()))], ["doc_id", "n_tokens", "p"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _rate(history: list[list[float]], ridge: float, least: float, most: float) -> Column:
    """A document's rate after the steps so far."""
    step = 1 / (2 + 2 * ridge)
    dot = lambda g: sum((F.col("p")[k] * g[k] for k in range(len(DOMAINS))), F.lit(0.0))
    one = lambda r, g: F.least(F.lit(most), F.greatest(F.lit(least), r - F.lit(step) * (F.lit(2.0) * dot(g) + F.lit(2 * ridge) * (r - 1))))
    if not history:
        return F.lit(min(most, max(least, 1.0)))
    return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in history]), F.lit(min(most, max(least, 1.0))), one)


def solve(members: DataFrame, weights: dict[str, float], budget: float = 1.0, ridge: float = 1e-3, least: float = 0.0, most: float = 1e6, steps: int = 30) -> list[list[float]]:
    """The steps' coefficients; ``_rate`` folds them."""
    unit = [F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(DOMAINS))]
    base = [float(x or 0) for x in members.agg(*unit).first()]
    total = sum(base)
    if not total:
        return []
    share = sum(weights.values())
    target = [budget * weights.get(d, 0.0) / share for d in DOMAINS]
    scale = [b / total for b in base]
    history: list[list[float]] = []
    before: list[float] | None = None
    for _ in range(steps):
        r = _rate(history, ridge, least, most)
        now = [float(x) / total for x in members.select("n_tokens", "p", r.alias("r")).agg(*[F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[k]) for k in range(len(DOMAINS))]).first()]
        if before and max(abs(a - b) for a, b in zip(now, before, strict=True)) < 1e-9:
            break
        before = now
        history.append([(e - t) / s if s > 1e-12 else 0.0 for e, t, s in zip(now, target, scale, strict=True)])
    return history


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, ridge: float = 1e-3, least: float = 0.0, most: float = 1e6) -> DataFrame:
    """(doc_id, n_tokens, p_high, p_low, p_toxic, rate, copies): copies is the rate rounded up or down by a hash of doc_id, so that its mean is the rate."""
    members = stored(memberships(docs, fit(docs, labels)), "memberships")
    history = solve(members, weights or WEIGHTS, budget, ridge, least, most)
    out = members.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], _rate(history, ridge, least, most).alias("rate"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, least: float = 0.0) -> DataFrame:
    """The documents, each row as often as its rate says. Rows without a doc_id go."""
    key, times, copy = (unused(docs, n) for n in ("mixed_id", "mixed_copies", "mixed_copy"))
    often = rates(docs, labels, weights, budget, least=least).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(often, F.col("doc_id") == F.col(key)).where(F.col(times) > 0)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*names)


def totals(rated: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """(domain, tokens, target, achieved) of the result of ``rates``: how near each domain's expected total came, in tokens."""
    weights = weights or WEIGHTS
    sums = rated.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(f"t_{d}") for d in DOMAINS], *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(f"a_{d}") for d in DOMAINS])
    rows = [F.struct(F.lit(d).alias("domain"), F.coalesce(f"t_{d}", F.lit(0.0)).alias("tokens"), (F.coalesce("n", F.lit(0)) * float(budget * weights.get(d, 0.0) / sum(weights.values()))).alias("target"), F.coalesce(f"a_{d}", F.lit(0.0)).alias("achieved")) for d in DOMAINS]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
