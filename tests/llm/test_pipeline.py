"""The five stages in sequence, each against a plain version of what it says."""

import random

import numpy as np
import pytest

import corpus_pipeline as c
from docloom.llm import decontam, mixing, toxicity
from tests.llm.test_decontam import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, prose(rng.randint(20, 80)) + (" idiot moron scum" if k % 6 == 0 else "")) for k in range(120)]
    long = prose(200)
    rows += [(200 + k, " ".join(w if j != 17 * k + 3 else "changed" for j, w in enumerate(long.split()))) for k in range(4)] + [(210, long), (211, long)]
    items = [(k, prose(20)) for k in range(3)]
    rows += [(220 + k, prose(30) + " " + items[k][1].upper() + " " + prose(5)) for k in range(3)]
    rows += [(230, None), (231, ""), (232, "   "), (233, "x" * 50_000), (234, rows[1][1]), (1, rows[1][1]), (None, "no id"), (235, "word " * 20_000)]
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "extra") for k, (i, t) in enumerate(rows)]
    labels = [(k, int(k % 5 > 0), int(k % 6 == 0)) for k in range(120)] + [(1, None, None), (None, 1, 0)]
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mixed_id string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def shingles(text):
    w = "".join(x.lower() if x.isascii() else x for x in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows, percent=80):
    """The ids that a plain comparison of all pairs keeps."""
    sets = {}
    for i, t in rows:
        sets[i] = max(sets.get(i, set()), shingles(t), key=len)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i in ids if root(i) == i}


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels, items = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    have, frames = sorted(map(tuple, docs.collect()), key=repr), []
    for name, stage in c.STAGES:
        out = c.stored(stage(spark, docs, tables), f"test-{name}")
        now = sorted(map(tuple, out.collect()), key=repr)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert now == [r for r in have if r[0] is not None and r[0] not in bad] and len({k for k in range(0, 120, 6)} & bad) > 12 and len(bad) < 30
        elif name == "near_duplicates":
            keep = one_of_each([r[:2] for r in have])
            assert now == [r for r in have if r[0] in keep] and len(now) < len(have) - 4
        elif name == "decontamination":
            hit = {i for i, _ in brute([(r[0], r[1]) for r in have if len(r[1] or "") < 5000], [tuple(r) for r in items.collect()])}
            assert hit and now == [r for r in have if r[0] not in hit]
            assert {r.doc_id for r in decontam.contaminated(docs, items).collect()} == hit
        elif name == "mixture":
            copies = {r.doc_id: r.copies for r in mixing.rates(docs, labels, c.WEIGHTS, c.BUDGET, least=c.LEAST_RATE).collect()}
            assert now == sorted((r for r in have for _ in range(copies[r[0]])), key=repr) and len(now) > len(have)
        else:
            assert [r[0] for r in sorted(now)] == sorted(r[0] for r in have) and sum(r[2] for r in now) == max(r[1] + r[2] for r in now)
        if name != c.STAGES[-1][0]:
            assert out.columns == docs.columns
        frames.append(out)
        docs, have = out, now
    final = sorted(map(tuple, c.run(spark, tables).collect()))
    assert final == sorted(map(tuple, frames[-1].collect()))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_mixing_reaches_the_least_squares_optimum(spark, tables):
    """Rates of the distributed steps against the optimum of the same objective, solved over arrays until it stands still."""
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    rows = mixing.rates(docs, labels, {"high": 0.6, "low": 0.3, "toxic": 0.1}).collect()
    n, p = np.array([r.n_tokens for r in rows], float), np.array([[r.p_high, r.p_low, r.p_toxic] for r in rows])
    total, s, t, ridge = n.sum(), (n[:, None] * p).sum(axis=0) / n.sum(), np.array([0.6, 0.3, 0.1]), 1e-3
    value = lambda r: ((((n * r) @ p / total - t) ** 2) / s).sum() + ridge * (n / total * (r - 1) ** 2).sum()
    r = np.ones(len(n))
    for _ in range(20_000):
        r = np.maximum(0, r - (2 * p @ (((n * r) @ p / total - t) / s) + 2 * ridge * (r - 1)) / (2 + 2 * ridge))
    mine = np.array([x.rate for x in rows])
    assert value(mine) <= value(r) + 1e-3 and (mine >= 0).all() and value(mine) < value(np.ones(len(n))) / 5
