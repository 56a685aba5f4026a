"""Alignment of two tokenizers over the same text.

A is a byte-level BPE and reads a space and the text; B is a sentencepiece model and adds the space itself. Both give the
bytes of the text in order, so a token is a byte range.

1. Some documents at a time are laid end to end, with the byte offset of each. The ends of A's and of B's tokens are
   counted by byte (``bincount``). A byte where both end is a cut between groups; a byte where either ends is the end of
   a link, an A token and a B token that overlap. Running sums over the whole, taken at the documents' last bytes, give
   the numbers of each document.
2. Blocks of some 8 MB of text are written with their links. The distinct links of a block and their numbers are summed
   over all blocks: the count of an id pair. A B id's highest count (one row per B id, at most 65,536) marks its best pairs.
3. Each block gets the counts of its own distinct pairs back, by the block's number, and adds them up by document. So a
   pair that is everywhere costs one row for each block, not one for each occurrence.

Texts that are null, empty, or whose A or B bytes are not exactly the space and the text have no tokens and count
nothing. Rows that repeat a doc_id give a row each; rows without one are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import byte_bpe, flat, vocabulary
from docloom.llm.common import id_text, stored, text_chunks

CHUNK, CHUNKS = 1 << 20, 8
_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_BLOCK = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, n_links long, links binary"


class TokenBytes:
    """The bytes of every token of a vocabulary, to be joined for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << 16:
            raise ValueError("a link holds two ids of 16 bits: the vocabulary is larger")
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=2)
def _second(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, TokenBytes(tokens)


@lru_cache(maxsize=2)
def _first(path: str):
    model = byte_bpe(path, True)
    return model, TokenBytes(model.bytes)


def exact(ids: np.ndarray, counts: np.ndarray, tokens: TokenBytes, want: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each document, whether its tokens' bytes are its bytes ``want[offs[k]:offs[k + 1]]``."""
    size = tokens.size[ids]
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, size, len(counts)).astype(np.int64)
    same = total == np.diff(offs)
    kept = ids[same[owner]]
    places = np.repeat(same, np.diff(offs))
    wrong = tokens.joined(kept) != want[places]
    bad = np.repeat(np.arange(len(counts)), np.diff(offs))[places][wrong]
    same[bad] = False
    return same


def aligned(end_a: np.ndarray, end_b: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of tokens laid end to end, given where they end: (A token of each link, B token of each link, group of each A token, group of each B token, n_a, n_b, n_groups, n_links by document)."""
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    a, b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
    cut, end = a & b, a | b
    upto = [np.cumsum(x) for x in (a, b, cut, end)]
    link = np.flatnonzero(end)
    by_doc = [np.diff(x[doc_ends], prepend=0) for x in upto]
    return upto[0][link] - a[link], upto[1][link] - b[link], upto[2][end_a] - cut[end_a], upto[2][end_b] - cut[end_b], *by_doc


def group_text(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;...;`` in ASCII bytes, and where each A token and each B token begins in it."""
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    of_a, of_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]  # a group's A tokens stand before its B tokens
    at_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
    n = len(a) + len(b)
    ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[np.cumsum(of_a) - 1]], mark[at_b[np.cumsum(of_b) - 1]] = ord("|"), ord(";")
    digits = np.zeros((n, 6), np.uint8)
    rest = ids
    for k in range(4, -1, -1):
        rest, digits[:, k] = rest // 10, rest % 10 + 48
    digits[:, 5] = mark
    size = 1 + (ids[:, None] >= 10 ** np.arange(1, 5)).sum(axis=1)
    shown = np.arange(6) >= 5 - size[:, None]
    begin = np.cumsum(size + 1) - (size + 1)
    return digits[shown], begin[at_a], begin[at_b]


def chunk_alignment(texts: list[bytes], path_a: str, path_b: str) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups_sha256 of each text; links as A id << 16 | B id in order)."""
    (model_a, tokens_a), (model_b, tokens_b) = _first(path_a), _second(path_b)
    words = [t.decode(errors="replace") for t in texts]
    a, n_a = flat(model_a.encode([" " + w if w else "" for w in words]))
    b, n_b = flat(model_b.encode(words, num_threads=1) if words else [])
    want = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
    offs = np.append(0, np.cumsum([len(t) + 1 if t else 0 for t in texts])).astype(np.int64)
    good = exact(a, n_a, tokens_a, want, offs) & exact(b, n_b, tokens_b, want, offs) & (np.diff(offs) > 0)
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    ends = np.cumsum(np.where(good, np.diff(offs), 0))
    link_a, link_b, group_a, group_b, *by_doc = aligned(np.cumsum(tokens_a.size[a]), np.cumsum(tokens_b.size[b]), ends)
    text, begin, _ = group_text(a, b, group_a, group_b)
    first = np.append(begin, len(text))[np.append(0, np.cumsum(by_doc[0]))]
    raw = text.tobytes()
    digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), by_doc, strict=True)) | {"groups_sha256": digests}
    return out, (a[link_a] << 16 | b[link_b]).astype("<u4")


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held, links = TaskContext.get().partitionId() << 33, 0, [], []

        def block() -> pa.RecordBatch:
            docs = pa.concat_arrays(held)
            pairs = np.concatenate(links)
            row = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([pa.array([base + n]), row, pa.array([len(pairs)], pa.int64()), pa.array([pa.compress(pairs.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "docs", "n_links", "links"])

        for ids, data, offs in text_chunks(batches, CHUNK):
            raw = data.tobytes()
            found, pairs = chunk_alignment([raw[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)], path_a, path_b)
            found["doc_id"] = ids
            held.append(pa.StructArray.from_arrays([pa.array(found[name], kind) for name, kind in _DOC], [name for name, _ in _DOC]))
            links.append(pairs)
            if len(held) == CHUNKS or sum(map(len, links)) * 2 > CHUNK * CHUNKS:
                yield block()
                n, held, links = n + 1, [], []
        if held:
            yield block()

    return run


def _pairs(links: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(links.as_buffer(), 4 * n, "zstd"), "<u4") if n else np.zeros(0, "<u4")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n): how often a block holds each of its links."""
    for batch in batches:
        for k in range(batch.num_rows):
            pair, n = np.unique(_pairs(batch.column("links")[k], batch.column("n_links")[k].as_py()), return_counts=True)
            for at in range(0, len(pair), 1 << 16):
                some = pair[at : at + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column("block")[k].as_py())), pa.array(some), pa.array(n[at : at + (1 << 16)])], ["block", "pair", "n"])


def _scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links of what ``counts`` says of each pair."""
    pair, order = counts.column("pair").to_numpy(), None
    order = np.argsort(pair)
    pair, count, best = pair[order], counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
    out = []
    for k in range(blocks.num_rows):
        docs = blocks.column("docs")[k].values
        at = np.searchsorted(pair, _pairs(blocks.column("links")[k], blocks.column("n_links")[k].as_py()))
        ends = np.cumsum(docs.field("n_links").to_numpy())
        sums = [np.diff(np.append(0, np.cumsum(x[at]))[ends], prepend=0).astype(np.int64) for x in (best.astype(np.int64), count)]
        out.append(pa.table([*docs.flatten(), pa.array(sums[0]), pa.array(sums[1])], [*(name for name, _ in _DOC), "n_best", "count_sum"]))
    schema = pa.schema([*_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()


def aligned_blocks(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(block, docs, n_links, links): documents in blocks, and their links in order (compressed unsigned 32-bit, A id << 16 | B id)."""
    return stored(id_text(docs).mapInArrow(_blocks(a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")), _BLOCK), "aligned")


def pair_counts(distinct: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold a pair, and whether no pair of its B id has more."""
    counts = distinct.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.expr("pair & 65535").alias("b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.expr("pair & 65535") == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document."""
    blocks = aligned_blocks(docs, a, b)
    distinct = stored(blocks.select("block", "n_links", "links").mapInArrow(_distinct, "block long, pair long, n long"), "distinct-links")
    counts = stored(pair_counts(distinct), "pair-counts")
    known = distinct.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    names = ", ".join(f"{name} {'string' if name == 'groups_sha256' else 'long'}" for name, _ in _DOC)
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored, f"{names}, n_best long, count_sum long")
