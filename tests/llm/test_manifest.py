import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def climb(nodes):
    """(root, for each node its siblings as (first, node))."""
    proof = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(at):
            s = p ^ 1
            proof[k].append((bool(p & 1), level[s] if s < len(level) else None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], proof


def fold(node, steps):
    for first, s in steps:
        node = h(node) if s is None else h(s, node) if first else h(node, s)
    return node


def plain(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = climb([leaf(*r) for r in groups[g]])
    root, outer = climb([trees[g][0] for g in langs])
    out = []
    for g, more in zip(langs, outer, strict=True):
        for r, steps in zip(groups[g], trees[g][1], strict=True):
            steps = steps + more
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                shown = (*r[:3], r[3] + 1, r[4])
            end = fold(leaf(*shown), steps)
            out.append((r[0], leaf(*r), trees[g][0], root, h(*[s for _, s in steps if s]), end, end == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, node string").repartition(3)


ROWS = [(k * 37 % 101, f"s{k % 3}", ["en", "de", None, "é", "z", ""][k % 6 if k < 30 else 0], None if k % 11 == 0 else k, ["", None, "Größe", "x" * 50][k % 4]) for k in range(101)]
ODD = [(None, None, None, None, None), (7, "s", "en", 1, "twice"), (7, "s", "en", 1, "twice"), (9, "s", "one", 2**62, "long " * 100_000), (-5, "s", "en", -3, "\n")]


def got(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=repr)


@pytest.mark.parametrize("rows", [ROWS, ROWS + ODD, ROWS[:1], ODD[:3]])
def test_proofs_equal_a_plain_tree(spark, rows):
    assert got(manifest.document_manifest(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("bits", [2, 3])
def test_several_tiers_of_small_buckets(spark, bits):
    df = frame(spark, ROWS + ODD)
    columns = [F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")]
    m = manifest.manifest(df, F.col("lang"), F.col("doc_id"), columns, bits=bits).withColumn("folded", manifest.folded(F.col("leaf"), F.col("steps")))
    want = sorted([(x[0], *x[1:5], x[3]) for x in plain(ROWS + ODD)], key=repr)
    assert sorted([(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded) for r in m.withColumn("proof", manifest.siblings(F.col("steps"))).collect()], key=repr) == want


def test_a_joined_tier_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0)
    assert got(manifest.document_manifest(frame(spark, ROWS))) == plain(ROWS)


def test_empty_table(spark):
    df = manifest.document_manifest(frame(spark, ROWS).limit(0))
    assert df.count() == 0 and "verified" in df.columns


def test_tampered_rows_alone_fail(spark, sf_small):
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    r = manifest.document_manifest(d).withColumn("hit", F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert r.where("hit = verified").count() == 0 and r.where("hit").count() > 0
