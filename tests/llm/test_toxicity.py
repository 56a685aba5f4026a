import zlib

import numpy as np

from docloom.llm import toxicity as x
from docloom.llm.common import prefix_hash, range_hash


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = x.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    slots = rng.integers(0, 1000, (9, 7))
    steps = [s.astype(np.float64) for s in net.projected(net.vectors(slots).astype(np.float64))]
    ids = rng.integers(0, 10, (5, 6))
    mask = (np.arange(6) < np.array([6, 3, 1, 5, 6])[:, None]).astype(float)
    y, w = rng.integers(0, 2, 5).astype(float), rng.random(5)
    _, g, dx = net.gradient(steps, ids, mask, y, w)
    loss = lambda: net.gradient(steps, ids, mask, y, w)[0]
    net.run = lambda *a, run=net.run, **k: run(*a, **k)
    for name in ("Uf", "Ub", "A", "v", "o", "c"):
        flat = net.p[name].reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 1e-4
    for d in (0, 1):
        total = np.zeros_like(steps[d])
        np.add.at(total, ids.T, dx[d])
        old = steps[d][4, 5]
        steps[d][4, 5] = old + 1e-3
        up = loss()
        steps[d][4, 5] = old - 1e-3
        down = loss()
        steps[d][4, 5] = old
        assert abs((up - down) / 2e-3 - total[4, 5]) < 1e-4


def plain_scores(net, text):
    """The logit of each window of a text: word by word, unit by unit, from the definitions."""
    raw = text.lower().encode()
    words, now = [], b""
    for c in [*raw, 32]:
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            now += bytes([c])
        elif now:
            words.append(now)
            now = b""
    hashed = lambda b: int(range_hash(prefix_hash(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(w):
        grams = [hashed(w)] + [hashed(w[:k]) ^ k for k in (3, 4, 5, 6)] + [hashed(w[-3:]) ^ 9]
        return np.concatenate([net.word[hashed(w) % x.WORD_SLOTS], np.mean([net.gram[g % x.GRAM_SLOTS] for g in grams], axis=0)]).astype(float)

    out = []
    starts = [0] if len(words) <= x.WINDOW else [*range(0, len(words) - x.WINDOW, x.STRIDE), len(words) - x.WINDOW]
    for a in starts if words else []:
        some = [vector(w) for w in words[a : a + x.WINDOW]]
        both = []
        for d, order in (("f", some), ("b", some[::-1])):
            h, states, n = np.zeros(x.HIDDEN), [], x.HIDDEN
            for v in order:
                i, r = v @ net.p["W" + d] + net.p["b" + d], h @ net.p["U" + d]
                z, reset = sig(i[:n] + r[:n]), sig(i[n : 2 * n] + r[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(i[2 * n :] + reset * r[2 * n :])
                states.append(h)
            both.append(states if d == "f" else states[::-1])
        states = [np.concatenate(p) for p in zip(*both, strict=True)]
        weight = np.exp([np.tanh(s @ net.p["A"]) @ net.p["v"] for s in states])
        out.append(sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True)) @ net.p["o"] + net.p["c"][0])
    return out


def test_forward_pass_against_a_plain_one():
    net, rnd = x.Network(11), np.random.default_rng(4)
    for v in net.p.values():
        v += rnd.normal(0, 0.3, v.shape).astype(np.float32)
    vocabulary = ["a", "ab", "abc", "Word", "größe", "1234567", "x" * 40, "don", "日本語"]
    texts = ["", "...", "one", " ".join(rnd.choice(vocabulary, 24)), ", ".join(rnd.choice(vocabulary, 25)), " ".join(rnd.choice(vocabulary, 80)), "a-b_c"]
    raw = [t.encode() for t in texts]
    number, first, slots = x.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    text, _, logit = x.window_logits(net, number, first, slots)
    for k, t in enumerate(texts):
        want = plain_scores(net, t)
        assert len(want) == (text == k).sum() and np.allclose(logit[text == k], want, atol=1e-4)


def test_windows_cover_and_overlap():
    sizes = [0, 1, 24, 25, 36, 37, 500]
    first = np.cumsum([0, *sizes])
    text, start = x.windows(first)
    for k, n in enumerate(sizes):
        s = start[text == k] - first[k]
        assert set(range(n)) == {p for a in s for p in range(a, min(n, a + x.WINDOW))}
        assert all(0 < b - a <= x.STRIDE for a, b in zip(s, s[1:], strict=False)) and (not n or s[-1] == max(0, n - x.WINDOW))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = x.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    good = sum(r.predicted == r.toxic for r in rows)
    caught = [r.predicted for r in rows if r.toxic]
    assert len(rows) > 800 and good / len(rows) > 0.97 and np.mean(caught) > 0.85


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "b"), (3, "...", "c"), (4, "word " * 40_000, "d"), (5, "you are an idiot", "e"), (5, "you are an idiot", "e"), (None, "x", "f")]
    docs += [(k, ("kind words here " * 9 + ("idiot moron " if k % 3 == 0 else "friend ")) * 2, "s") for k in range(10, 90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0), 0.5) for k in range(10, 90)] + [(11, 1, None, 0.1), (None, 1, 1, 0.1)], "doc_id long, quality int, toxic int, score double")
    rows = x.toxicity(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) - 1 and [got[k].score for k in (1, 2, 3)] == [0, 0, 0]
    assert got[5].predicted == 1 and got[4].predicted == 0 and got[4].n_windows == 1 + -(-(40_000 - 24) // 12)
    assert {r.doc_id for r in x.keep_clean(df, labels).collect()} == {r.doc_id for r in rows if not r.predicted}
    assert {r.score for r in x.toxicity(df, labels.where("toxic = 0")).collect()} == {0.0}
    assert x.toxicity(df.limit(0), labels.limit(0)).count() == 0
