import hashlib
from collections import Counter

from docloom.llm import alignment
from docloom.llm.byte_bpe import byte_bpe, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain(texts):
    """The same by comparing every A token with every B token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    a_bytes = byte_bpe(A, True).bytes
    out, every = [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes) != want:
            out.append(([], [], "", 0))
            continue
        spans = []
        for sizes in ([len(a_bytes[i]) for i in a], [len(x) for x in b_bytes]):
            at, mine = 0, []
            for n in sizes:
                mine.append((at, at + n))
                at += n
            spans.append(mine)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e]
        every.update(links)
        cut = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], 0
        for c in cut:
            groups.append(",".join(str(a[i]) for i, (s, e) in enumerate(spans[0]) if at <= s < c) + "|" + ",".join(str(b[j]) for j, (s, e) in enumerate(spans[1]) if at <= s < c))
            at = c
        out.append((links, (a, b), ";".join(groups), len(groups)))
    most: dict[int, int] = {}
    for (_, j), n in every.items():
        most[j] = max(most.get(j, 0), n)
    return [(len(t[0]) if t else 0, len(t[1]) if t else 0, n, len(links), hashlib.sha256(text.encode()).hexdigest() if text else "", sum(every[p] == most[p[1]] for p in links), sum(every[p] for p in links)) for links, t, text, n in out]


TEXTS = [None, "", " ", "a", "Größe über alles", "日本語のテキスト", "it's  two\n\nlines\t.", "▁ stays a mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01", "😀 smile", "hello hello hello", "hello hello hello", "ends with space ", "ﬁ ligature ｆｕｌｌ", "a" * 300, "1234567890 " * 20]


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_links_groups_and_counts_equal_every_pair_compared(spark):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, block string, pair int").repartition(3)
    assert rows(alignment.alignment(df)) == plain(TEXTS)


def test_counts_meet_over_blocks(spark, monkeypatch, sf_small):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [(t or "")[:1500] for t in texts]
    monkeypatch.setattr(alignment, "CHUNK", 2000)
    monkeypatch.setattr(alignment, "CHUNKS", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert alignment.aligned_blocks(df).count() > 4
    assert rows(alignment.alignment(df)) == plain(texts)


def test_repeated_rows_a_long_text_and_an_empty_table(spark):
    long = "some words and other words " * 60_000
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "lost"), (2, long)], "doc_id long, text string")
    got = rows(alignment.alignment(df))
    assert len(got) == 3 and got[0] == got[1] and got[2][3] >= max(got[2][:2]) and got[2][3] == got[2][0] + got[2][1] - got[2][2]
    assert alignment.alignment(df.limit(0)).count() == 0
