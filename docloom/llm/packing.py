"""Sum-of-squares packing of token sequences.

Every text is encoded, an end id is added, and what is longer than a sequence is cut into pieces of its size, the first of
which may be shorter. Pieces of the whole size are sequences. The others are placed one by one, the longest first: into the
open bin, or a new one, after which the sum over all residual gaps of the squared number of open bins with that gap is
smallest; among equals into the fullest. Bins with the same gap are alike, so a placement looks at one counter per gap.

Placing is done in blocks of some 8,192 pieces, dealt by a hash, each in one task with its token ids (at most 64 MB). Full
bins are final. The pieces of the others, about a tenth, are taken out again and dealt into fewer blocks, round by round,
until one block holds them all or a round fills few bins (then its bins stay as they are, which is best for texts of
which no two fit together). In the last block the same is repeated until no further bin becomes full.

``sequences`` gives the packed sequences themselves: ids as little-endian unsigned 32-bit integers, and where each piece lies.
``placements`` lists the pieces with digests of the bytes in the sequences.

Nulls and empty texts are the end id alone. Rows that repeat a doc_id are packed each by itself and give a row each; rows
without a doc_id are left out. An empty table gives no sequence. A lost executor costs its tasks: every round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.byte_bpe import byte_bpe, vocabulary
from docloom.llm.common import binary_rows, id_text, stored, text_chunks

SIZE, END_ID, BLOCK = 2048, 0, 8192
_PIECE = "doc_id long, piece int, start long, ids binary"
_PARTS = "array<struct<doc_id:long,piece:int,start:long,offset:long,length:long>>"


def cuts(n: int, size: int) -> np.ndarray:
    """Where pieces of ``n`` ids begin and end: whole ones from the back, so only the first may be shorter."""
    return np.append(0, np.arange(n % size or size, n + 1, size))


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for ids, data, offs in text_chunks(batches):
            raw = data.tobytes()
            docs, numbers, starts, parts = [], [], [], []
            for doc, code in zip(ids.tolist(), encoder.encode([raw[a:b].decode(errors="replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]), strict=True):
                code.append(end_id)
                code = np.array(code, "<u4")
                at = cuts(len(code), size).tolist()
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    docs.append(doc)
                    numbers.append(k)
                    starts.append(a)
                    parts.append(code[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), binary_rows(parts)], ["doc_id", "piece", "start", "ids"])

    return run


class Bins:
    """Open bins by level (used places), and the sum-of-squares rule over their counts."""

    def __init__(self, size: int):
        self.size, self.count, self.open, self.full = size, np.zeros(size + 1, np.int64), {}, []

    def level_for(self, length: int) -> int:
        """The level of the bin to take, 0 for a new one. Only counts at the level left and the level reached change."""
        reached = self.count[length:]  # by level left, from 0; at the end the full level, which never counts
        left = self.count[: self.size - length + 1]
        change = 2 * (reached - left) + 2
        change[0] = 2 * reached[0] + 1  # a new bin leaves no level
        change[-1] = 1 - 2 * left[-1] if self.size > length else 0
        change[1:][left[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, item: int, length: int) -> None:
        level = self.level_for(length)
        if level:
            self.count[level] -= 1
            members = self.open[level].pop()
        else:
            members = []
        members.append(item)
        if level + length == self.size:
            self.full.append(members)
        else:
            self.count[level + length] += 1
            self.open.setdefault(level + length, []).append(members)

    def rest(self) -> list[list[int]]:
        return [members for level in sorted(self.open, reverse=True) for members in self.open[level]]


def packed(lengths: np.ndarray, order: np.ndarray, size: int, last: bool) -> tuple[list[list[int]], list[list[int]]]:
    """(full bins, other bins) as lists of places in ``lengths``. ``last``: the others are taken apart and packed again while that fills any."""
    full: list[list[int]] = []
    while True:
        bins = Bins(size)
        for i in order.tolist():
            bins.place(i, int(lengths[i]))
        full += bins.full
        rest = bins.rest()
        if not last or not bins.full or not rest:
            return full, rest
        left = np.zeros(len(lengths), bool)
        left[[i for b in rest for i in b]] = True
        order = order[left[order]]


def _packing(size: int, last: bool):
    """Bins (full, ids, parts) of rows (block, doc_id, piece, start, ids) in order of block."""

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        doc, piece, start = (t.column(k).to_numpy() for k in ("doc_id", "piece", "start"))
        ids = t.column("ids").combine_chunks()
        lengths = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]) // 4
        full, rest = packed(lengths, np.lexsort([piece, doc, -lengths]), size, last)
        bins = full + rest
        for k in range(0, len(bins), 500):
            chosen = bins[k : k + 500]
            item = np.array([i for b in chosen for i in b])
            edge = np.zeros(len(chosen) + 1, np.int32)
            np.cumsum([len(b) for b in chosen], out=edge[1:])
            place = np.append(0, np.cumsum(lengths[item]))
            owner = np.repeat(np.arange(len(chosen)), np.diff(edge))
            parts = pa.StructArray.from_arrays([pa.array(doc[item]), pa.array(piece[item]), pa.array(start[item]), pa.array((place[:-1] - place[edge[:-1]][owner]).astype(np.int64)), pa.array(lengths[item].astype(np.int64))], ["doc_id", "piece", "start", "offset", "length"])
            body = b"".join(ids[i].as_buffer().to_pybytes() for i in item.tolist())
            joined = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer((4 * place[edge]).astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(chosen)) < len(full)), joined, pa.ListArray.from_arrays(pa.array(edge), parts)], ["full", "ids", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            block = batch.column("block").to_numpy()
            if block[-1] != held[0].column("block")[0].as_py():
                t = pa.Table.from_batches(held)
                block = t.column("block").to_numpy()
                edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
                for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                    yield from some(t.slice(a, b - a))
                held = t.slice(edges[-2]).to_batches()
        if held:
            yield from some(pa.Table.from_batches(held))

    return run


def sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """(sequence_id, ids, parts): the packed sequences, and for each piece its document, number, place there and here, and length."""
    pieces = stored(id_text(docs).mapInArrow(_pieces(tokenizer or vocabulary("byte_bpe_50k.json"), end_id, size), _PIECE), "pieces")
    whole = F.octet_length("ids") == 4 * size
    done = [pieces.where(whole).select("ids", F.expr(f"array(struct(doc_id, piece, start, 0L as offset, {size}L as length))").cast(_PARTS).alias("parts"))]
    rest = pieces.where(~whole)
    n, deal = rest.count(), 0
    while n:
        blocks = -(-n // block)
        dealt = rest.select(F.expr(f"pmod(xxhash64(doc_id, piece, start, {deal}), {blocks})").alias("block"), "doc_id", "piece", "start", "ids")
        dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block")
        got = stored(dealt.mapInArrow(_packing(size, blocks == 1), f"full boolean, ids binary, parts {_PARTS}"), "packed")
        opened = got.where("not full")
        left = opened.agg(F.sum(F.size("parts"))).first()[0] or 0
        if blocks == 1 or 2 * left > n:
            done.append(got.select("ids", "parts"))
            break
        done.append(got.where("full").select("ids", "parts"))
        rest = opened.select("ids", F.explode("parts").alias("p")).select("p.doc_id", "p.piece", "p.start", F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))").alias("ids"))
        n, deal = left, deal + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.monotonically_increasing_id().alias("sequence_id"), "ids", "parts")


def placements(packed_sequences: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece, the digest read from its sequence."""
    p = packed_sequences.select("sequence_id", "ids", F.explode("parts").alias("p"))
    ids = F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))")
    return p.select("p.doc_id", "p.piece", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "sequence_id", "p.offset")
