import re


from docloom.llm import neardup
from docloom.llm.neardup import least_matches, near_duplicates

SCHEMA = "doc_id long, text string, source string, a string, rep string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_chains_hot_groups_and_odd_rows(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: 120 - k % 9])) for k in range(60)]  # a chain: its ends are under the limit
    rows += [(100 + k, " ".join(base) + f" tail{k}") for k in range(50)] + [(200 + k, "the same text here again") for k in range(50)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One two"), (304, "one  TWO"), (305, "one two three"), (306, "É x y z w v"), (307, "é x y z w v")]
    rows += [(400, "long " + " ".join(f"q{k}" for k in range(20_000)))]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_missing_ids(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(5, 2, 5, True)]


def test_bounds_keep_pairs_at_the_limit():
    from math import comb

    p = 0.85 + 0.15 / 256
    for n, m in least_matches():
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m)) < 1e-4


def test_buckets_larger_than_a_slot(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLOT", 5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[: 60 - k % 3] + [f"x{k}-{j}" for j in range(k % 11)])) for k in range(80)]
    assert found(spark, rows) == brute(rows)


def test_the_stage_collapses_pairs_from_80_percent(spark):
    words = [f"w{k}" for k in range(304)]
    rows = []
    for k in range(40):  # pairs of 0.80 to 0.85: 300 shingles each, one changed run of words at the end
        own = [f"{w}-{k}" for w in words]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 304 - 25 - k % 9] + [f"x{j}-{k}" for j in range(25 + k % 9)]))]
    rows += [(100, " ".join(words)), (101, " ".join(words[:264] + [f"y{j}" for j in range(40)]))]  # under 0.80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in neardup.keep_one_of_each(df).collect()}
    assert left == {2 * k for k in range(40)} | {100, 101}
    assert near_duplicates(df).where("kept").count() == len(rows)


def test_bands_find_pairs_at_the_limits():
    for limits in (neardup.CONTRACT, neardup.STAGE):
        assert limits.miss_chance() < 1.5e-6 and limits.bands * limits.rows <= neardup.HASHES
