import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing
from docloom.llm.byte_bpe import byte_bpe, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def library(text, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s():
    rnd = random.Random(3)
    letters = ["a", "it's", "DON'T", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "Điều", "日本", "٣", "½", " ", "　", "\u0085", " ", "᠎", "\x1c", "​", "😀", "\U0001fae8", "123", "!?", "<|endoftext|>", "́", "ⅷ", "_", "\x00"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(3000)] + [chr(c) + "a " + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["a" * 5000, " " * 300 + "x"]
    from tokenizers import Tokenizer

    for plain in (False, True):
        t = Tokenizer.from_file(PATH)
        t.encode_special_tokens = plain
        want = [c.ids for c in t.encode_batch(texts, add_special_tokens=False)]
        assert byte_bpe(PATH, plain).encode(texts) == want


def test_token_bytes_are_the_text():
    model, text = byte_bpe(PATH, True), "Größe, 日本 <|endoftext|>\n 1"
    assert b"".join(model.bytes[i] for i in model.encode([text])[0]).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(12, 16))
def test_each_place_is_where_the_squares_are_fewest(lengths, size):
    bins = packing.Bins(size)
    levels: list[int] = []
    for k, n in enumerate(lengths):

        def squares(after):
            return sum(after.count(v) ** 2 for v in set(after) if v < size)

        options = [(squares([*levels, n]), 0)] + [(squares([*levels[:i], v + n, *levels[i + 1 :]]), -v) for i, v in enumerate(levels) if v + n <= size]
        least = min(options)
        before = len(bins.full) + sum(map(len, bins.open.values()))
        bins.place(k, n)
        after = len(bins.full) + sum(map(len, bins.open.values()))
        if least[1]:
            levels.remove(-least[1])
            levels.append(-least[1] + n)
        else:
            levels.append(n)
        assert after - before == (least[1] == 0)
        levels = [v for v in levels if v < size]
        now = np.bincount(levels, minlength=size + 1) if levels else np.zeros(size + 1)
        assert (now == bins.count).all()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")


def checked(spark, rows, size, block):
    got = packing.placements(packing.sequences(docs(spark, rows), size=size, block=block)).collect()
    want = []
    for doc, text, *_ in rows:
        if doc is None:
            continue
        ids = [*library(text or ""), 0]
        at = packing.cuts(len(ids), size).tolist()
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(w[3] for w in want) // size)
    return len(by), least


def test_pieces_of_odd_texts_and_gapless_sequences(spark):
    rnd = random.Random(1)
    words = "one two three four five six seven eight nine ten".split()
    rows = [(k, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 30, 60, 200]))), "x", 7) for k in range(600)]
    rows += [(5, rows[5][1], "x", 7), (5, "other", "x", 7), (1000, None, None, None), (1001, "", None, None), (None, "lost", None, None), (1002, "long word " * 40_000, "y", 1), (1003, "a <|endoftext|> b", "y", 1)]
    used, least = checked(spark, rows, 64, 100)
    assert used <= least * 1.03 + 2


def test_texts_of_which_no_two_fit_together(spark):
    rows = [(k, "a b c d e f g h", "", 0) for k in range(300)]
    assert checked(spark, rows, 12, 50)[0] == 300


def test_production_size_and_an_empty_table(spark, sf_small):
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = packing.placements(packing.sequences(d))
    n = got.selectExpr("count(distinct sequence_id) as n", "sum(length) as s", "count(distinct doc_id) as d").first()
    assert n.d == d.count() and n.n <= -(-n.s // 2048) + 6
    assert packing.placements(packing.sequences(d.limit(0))).count() == 0
