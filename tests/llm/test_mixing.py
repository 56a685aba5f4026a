import numpy as np
import pytest

from docloom.llm import mixing as m


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def plain(rows, weights, budget, ridge, least, steps=30):
    """The same steps over arrays."""
    n, p = np.array([r.n_tokens for r in rows], float), np.array([[r.p_high, r.p_low, r.p_toxic] for r in rows])
    total, s = n.sum(), (n[:, None] * p).sum(axis=0) / n.sum()
    t = budget * np.array([weights[d] for d in m.DOMAINS]) / sum(weights.values())
    r = np.ones(len(n))
    for _ in range(steps):
        e = (n[:, None] * p * r[:, None]).sum(axis=0) / total
        r = np.maximum(least, r - (2 * p @ ((e - t) / s) + 2 * ridge * (r - 1)) / (2 + 2 * ridge))
    return r, (n[:, None] * p * r[:, None]).sum(axis=0) / total, t


def test_totals_meet_the_targets(tables):
    docs, labels = tables
    rows = m.rates(docs, labels).orderBy("doc_id").collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)
    assert [r.n_tokens for r in rows[:200]] == [len((x.text or "").split()) for x in docs.orderBy("doc_id").limit(200).collect()]
    r, e, t = plain(rows, m.WEIGHTS, 1.0, 1e-3, 0.0)
    assert np.allclose(r, [x.rate for x in rows], atol=1e-6) and np.abs(e - t).max() < 0.01
    copies = np.array([x.copies for x in rows])
    assert (np.abs(copies - r) < 1).all() and abs(copies.mean() - r.mean()) < 0.1


def test_classifier_knows_its_domains(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in m.rates(docs, labels).collect()}
    right = [max(m.DOMAINS, key=lambda d: got[r.doc_id][f"p_{d}"]) == ("toxic" if r.toxic else "high" if r.quality else "low") for r in labels.collect()]
    assert np.mean(right) > 0.85


def test_least_rate_keeps_all(tables):
    docs, labels = tables
    rows = m.rates(docs, labels, {"high": 0.9, "low": 0.1, "toxic": 0.0}, budget=1.3, least=1.0).orderBy("doc_id").collect()
    assert min(r.copies for r in rows) == 1 and max(r.copies for r in rows) >= 2
    assert np.allclose(plain(rows, {"high": 0.9, "low": 0.1, "toxic": 0.0}, 1.3, 1e-3, 1.0)[0], [x.rate for x in rows], atol=1e-6)
    out = m.mixed(docs, labels, {"high": 0.9, "low": 0.1, "toxic": 0.0}, 1.3, 1.0)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows) and out.distinct().count() == docs.distinct().count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "w " * 50_000, 0.1), (4, "plain words", 0.1), (4, "plain words", 0.1), (None, "x", 0.2)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = m.rates(docs, none).collect()
    assert len(rows) == 5 and all(r.p_high == 1 for r in rows) and {r.doc_id: r.n_tokens for r in rows} == {1: 0, 2: 0, 3: 50_000, 4: 2}
    assert m.rates(docs.limit(0), none).count() == 0 and m.mixed(docs.limit(0), none).count() == 0
    assert m.mixed(docs, none, {"high": 1.0}, 2.0).count() >= 8
