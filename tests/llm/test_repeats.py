import hashlib
import random

import numpy as np

from docloom.llm import repeats as r

N = r.LENGTH


def brute(rows):
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256), by a table of all 50-byte strings."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - N + 1):
            s = b[p : p + N]
            least[s] = min(i, least.get(s, i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - N + 1):
            if least[b[p : p + N]] < i:
                gone[p : p + N] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, start int, bytes binary")
    return {x.doc_id: tuple(x)[1:5] for x in r.removed_repeats(df).collect()}


def test_table_against_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_hard_cases(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n, a="abcdefgh é\n": "".join(rng.choice(a) for _ in range(n))
    passage, other = text(400), text(120)
    rows = [(k, text(rng.randint(0, 200)) + passage[rng.randint(0, 99) : rng.randint(140, 400)] + text(rng.randint(0, 90))) for k in range(60)]
    rows += [(100 + k, other[k % 7 : 100 + k % 20]) for k in range(60)] + [(200 + k, "a" * (40 + k)) for k in range(30)]
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "ab" * 4000), (304, "ab" * 60), (305, passage + "\0" * 60), (306, "\0" * 55 + "q")]
    rows += [(400, "Z" + passage * 2), (401, passage * 2), (-5, passage[100:160])]
    monkeypatch.setattr(r, "_PIECE", 1000)
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 70), (1, "q" * 70), (2, "q" * 80), (None, "q" * 90)], "doc_id long, text string")
    assert sorted(tuple(x)[:4] for x in r.removed_repeats(df).collect()) == [(1, 70, 0, 0), (1, 70, 0, 0), (2, 80, 80, 1)]
    assert r.removed_repeats(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "a" * 60), (1, "b" * 60), (2, "b" * 60)], "doc_id long, text string")
    assert sorted(tuple(x)[:3] for x in r.removed_repeats(two).collect()) == [(1, 60, 0), (1, 60, 0), (2, 60, 60)]


def test_pieces_of_long_texts_agree():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = r.segments(data, np.array([0, 5000]))
    old, r._PIECE = r._PIECE, 700
    try:
        parts = r.segments(data, np.array([0, 5000]))
    finally:
        r._PIECE = old
    covered = lambda s: sorted(p for a, n in zip(s[1].tolist(), s[2].tolist(), strict=True) for p in range(a, a + n))
    assert covered(whole) == covered(parts) == list(range(5000 - N + 1))


def test_interval_tree():
    #          entries  0  1  2  3  4
    common = [0, 60, 70, 60, 0, 0]
    got = sorted(zip(*r.prefix_intervals(common), strict=True))
    assert got == [(60, 0, 3), (70, 1, 2)]


def test_maximal_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("qwertyuiop") for _ in range(60))
    rows = [(k, f"{k}" * 30 + shared + f"{chr(65 + k)}" * 40) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for x in r.maximal_repeats(df).collect():
        groups.setdefault((x.repeat, x.n_bytes), set()).add((x.doc_id, x.start))
    texts = dict(rows)
    for (_, n), members in groups.items():
        assert len({texts[d][s : s + n] for d, s in members}) == 1
    assert {(k, texts[k].index(shared)) for k in range(9)} in groups.values()
    left = {x.doc_id: x.text for x in r.without_repeats(df).collect()}
    assert left[0] == texts[0] and left[5] == texts[5].replace(shared, "")
