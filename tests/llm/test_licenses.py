import random
import re

from docloom.llm import licenses as x


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for label, p in x.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_base_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "CC-BY-NC cc by nc BY NC"), (5003, "Under  the_MIT@license 2"), (5004, "apache license, version 2.0 " * 3000), (5005, "é under the mit license"), (5006, "under the mit licensed")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, place int, label string")
    got = {r.doc_id: r for r in x.scan(df).collect()}
    assert len(got) == len(rows) and sum(r.n_base > 0 for r in got.values()) > 20
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1 if r.n_base else r.score < 1)


def test_notices_with_edits(spark):
    notice = dict(x.NOTICES)
    gpl = notice["gpl"].split()
    texts = {
        1: "intro words " + notice["bsd"].replace("source and", "source, code and") + " end",
        2: " ".join(gpl[:12] + ["really", "just"] + gpl[12:]),
        3: " ".join(gpl[:9]),
        4: notice["cc-by-nc"] + " " + notice["cc-by"],
        5: notice["isc"].upper() + " and " + notice["isc"],
        6: " ".join(reversed(gpl)),
        7: "free software you can redistribute it",
    }
    df = spark.createDataFrame(list(texts.items()) + [(1, texts[1]), (None, texts[2])], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_base) for r in x.scan(df).collect()}
    assert got == {1: ("bsd", 0), 2: ("gpl", 0), 3: ("", 0), 4: ("cc-by,cc-by-nc", 0), 5: ("isc", 0), 6: ("", 0), 7: ("", 0)}
    assert x.scan(df).count() == 8
    found = x.spans(df.where("doc_id = 5")).orderBy("word").collect()
    assert [(r.word, r.n_words) for r in found] == [(0, 20), (21, 20)]


def plain_notices(text):
    """(label, word, n_words, score) of the verified spans, by comparing every place with every template place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spans = []
    for label, notice in x.NOTICES:
        t = notice.split()
        n = len(t) - 2
        by: dict = {}
        for i in range(len(w) - 2):
            for j in range(n):
                if w[i : i + 3] == t[j : j + 3]:
                    by.setdefault(i - j, set()).add(j)
        runs = sorted((d + min(p), d, d + max(p) + 3, p) for d, p in by.items())
        stretches, reach = [], None
        for low, d, high, p in runs:
            if reach is None or low > reach + n:
                stretches.append([])
            stretches[-1].append((d, low, high, p))
            reach = high if reach is None else max(reach, high)
        for s in stretches:
            merged: list = []
            before = None
            for d, low, high, p in sorted(s, key=lambda r: r[0]):
                if before is not None and d - before <= 3:
                    merged[-1] = (min(merged[-1][0], low), max(merged[-1][1], high), merged[-1][2] | p)
                else:
                    merged.append((low, high, set(p)))
                before = d
            spans += [(-len(p) / n, -n, label, low, high) for low, high, p in merged if len(p) / n >= 0.6]
    kept: list = []
    for worse, _, label, low, high in sorted(spans):
        if all(low >= b or high <= a for _, a, b, _ in kept):
            kept.append((label, low, high, -worse))
    return sorted((label, a, b - a, round(s, 9)) for label, a, b, s in kept)


def test_notices_against_brute_force(spark):
    rnd, notices = random.Random(8), [t.split() for _, t in x.NOTICES]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rnd.randint(1, 4)):
            t = list(rnd.choice(notices))
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(t))
                t[at : at + rnd.randint(0, 2)] = rnd.choices(["really", "or", "license", "the"], k=rnd.randint(0, 2))
            words += rnd.choices(["filler", "word", "the"], k=rnd.randint(0, 30)) + t[rnd.randint(0, 3) : rnd.choice([len(t), len(t), len(t) * 2 // 3])]
        rows.append((k, " ".join(words)))
    # two notices that share most of their words, at equal shares in one place
    rows += [(900, "this work is licensed under a creative commons attribution 4 0 international license noncommercial 4 0 international license"), (901, (x.NOTICES[3][1] + " ") * 4), (902, "this work is licensed under a creative commons attribution")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {k: [] for k, _ in rows}
    for r in x.spans(df).where("not phrase").collect():
        got[r.doc_id].append((r.label, r.word, r.n_words, round(r.score, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_notices(t) for k, t in rows}
    assert sum(map(len, got.values())) > 100


def test_empty_table(spark):
    assert x.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
