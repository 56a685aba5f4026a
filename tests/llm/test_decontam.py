import random

import numpy as np

from docloom.llm import decontam as d

WS = " \t\n\v\f\r"


def norm(s):
    low = "".join(c.lower() if c.isascii() else c for c in s)
    for c in WS:
        low = low.replace(c, " ")
    return " ".join(x for x in low.split(" ") if x).encode()


def plain_edits(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for i, t in docs:
        for j, b in items:
            if (n := norm(b or "")) and (e := plain_edits(n, norm(t or ""))) <= d.budget(len(n)):
                out[i, j] = min(e, out.get((i, j), 1 << 30))
    return out


def make(spark, docs, items):
    x = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, edits string")
    return x, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")


def test_against_plain_alignment(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "é", "sh", "en"]) for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 25)))) for k in range(12)] + [(50, "short one"), (51, "  "), (52, None), (53, "tinytext")]

    def edited(s, n):
        for _ in range(n):
            p = rng.randrange(len(s))
            s = rng.choice([s[:p] + s[p + 1 :], s[:p] + "x" + s[p:], s[:p] + "q" + s[p + 1 :]])
        return s

    docs = []
    for k in range(60):
        body = edited(items[k % 12][1], rng.randint(0, 12)) if k % 3 else ""
        docs.append((k, " ".join(word() for _ in range(rng.randint(0, 30))) + " " + body.upper().replace("É", "é").replace(" ", "\n  ", 2) + " " + word()))
    docs += [(100, None), (101, ""), (102, "a SHORT  one."), (103, items[3][1]), (103, items[3][1]), (104, items[4][1] * 3)]
    a, b = make(spark, docs, items)
    rows = d.contaminated(a, b).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == brute(docs, items)
    assert sum(r.doc_id == 103 and r.item_id == 3 for r in rows) == 2
    cut = d.contaminated(a, b, broadcast_bytes=300).collect()
    assert sorted(cut) == sorted(rows)
    bad = {r.doc_id for r in rows}
    assert {r.doc_id for r in d.clean(a, b).collect()} == {i for i, _ in docs} - bad


def test_ranges_point_at_the_item(spark):
    items = [(1, "Some benchmark question about the long river, twice asked.")]
    docs = [(7, "x" * 5000 + " some  Benchmark question about\nthe long river, twice asked. " + "y" * 50)]
    a, b = make(spark, docs, items)
    (r,) = d.contaminated(a, b).collect()
    assert norm(docs[0][1])[r.start : r.end] == norm(items[0][1]) and r.edits == 0


def test_empty_tables(spark):
    a, b = make(spark, [], [])
    full_a, full_b = make(spark, [(1, "text of a document")], [(1, "text of a document")])
    assert d.contaminated(a, full_b).count() == d.contaminated(full_a, b).count() == 0
    assert d.contaminated(full_a, full_b).count() == d.clean(full_a, b).count() == 1


def test_alignment_alone():
    x = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    assert d.least_edits(x, np.frombuffer(b"zzabcdXefghijklmopzz", np.uint8), 3) == (2, 2, 18)
    assert d.least_edits(x, np.frombuffer(b"zzabcdXefghijklmopzz", np.uint8), 1) is None


def test_long_runs_of_one_character_and_ties(spark):
    line = "-" * 300
    docs = [(1, "-" * 100_000), (2, "x " + "-" * 290 + " y"), (3, "-" * 100), (4, "start " + "ab cd " * 40 + "middle " + "ab cd " * 40), (5, None)]
    items = [(1, line), (2, "ab cd " * 30)]
    a, b = make(spark, docs, items)
    rows = d.contaminated(a, b).collect()
    got = {(r.doc_id, r.item_id): (r.edits, r.start) for r in rows}
    assert got.keys() == {(1, 1), (2, 1), (4, 2)} and got[1, 1] == (0, 0) and got[2, 1][0] <= 18 and got[4, 2] == (0, 6)
    assert {(r.doc_id, r.item_id): (r.edits, r.start) for r in d.contaminated(a, b, broadcast_bytes=200).collect()} == got
