import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import token_files as t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=1600))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = t.pack_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (t.unpack_blocks(b"".join(blocks), starts) == ids).all()


ODD = ["", None, " ", "a\tb c", "don't it's O'Neil's", "x" * 5000, "É é ΣΑΣ İ ß ﬁ", "<|endoftext|> a <|startoftext|>b", "12 3.4,5!?!", "\x1c\x85 z", "日本語 テキスト", "word " * 3000]


def reference(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(t.default_tokenizer())
    return [[*tok.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_files_hold_the_library_ids(spark, monkeypatch):
    monkeypatch.setattr(t, "CACHED_WORDS", 40)
    w = t.WordIds(t.default_tokenizer(), 2)
    rows = [x for x in ODD if "<|" not in (x or "")] + ["a.b, c. d.e. .f ,g É. é, 1. 2, x…. don't. (it's)."]
    for some in (rows, ODD, rows[::-1]):
        raw = [(x or "").encode() for x in some]
        ids, counts = w.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference(some)


def test_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + k, x) for k, x in enumerate(ODD)] + [(77_777, "same"), (77_777, "same"), (None, "left out")]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, path int")
    manifest = t.write_token_files(df)
    got = sorted(tuple(r) for r in t.read_token_files(manifest).collect())
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want, at, every = [], 0, []
    for (i, _), ids in zip(rows, reference([x for _, x in rows]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        every += ids
    assert got == want
    part = sorted(t.read_range(manifest, 1000, 9000).collect())
    assert sum((r.ids for r in part), []) == every[1000:9000] and part[0].position == 1000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert t.read_token_files(t.write_token_files(df)).count() == 0


def test_no_shard(tmp_path):
    (tmp_path / "x").write_bytes(b"z" * 100)
    with pytest.raises(ValueError):
        t.ShardReader(str(tmp_path / "x"))
