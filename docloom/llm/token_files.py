"""Token ids in patched frame-of-reference files.

``write_token_files`` encodes each text with a public tokenizer, appends an end id, and writes the ids in ascending
doc_id order as shard files in the shared folder. ``read_token_files`` and ``read_range`` read them back.

A shard (little-endian):

* the magic bytes ``PFOR0001``;
* blocks of 512 ids (the last may be shorter): uint32 minimum, uint16 count, uint8 width, uint8 zero,
  uint16 number of exceptions, the id minus the minimum of each place packed low bit first at ``width`` bits
  (``width`` uint64 words for every 64 places), then the exceptions' uint16 places and uint32 upper parts
  (value >> width). The width is the number of bits of the block's 90th percentile, so at most a tenth of a
  block is patched;
* an index: uint64 start of each block, int64 doc_id and uint32 id count of each document;
* uint64 index start, uint64 ids, uint32 blocks, uint32 documents, the magic bytes again.

Ids come from the tokenizers library. White space ends every piece of the word-end BPE and ASCII case does not
matter to it, so each distinct word between spaces is encoded once per worker and looked up by a 64-bit hash after
that; the cache is emptied at a million words. Texts near the spelling of a special token go to the library whole.

Nulls and empty texts: the end id alone. Rows that repeat a doc_id stay rows, in text order. An empty table
gives no shard. A task that runs again writes a new file; the manifest names only files of finished tasks.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, id_text, new_folder, prefix_hash, range_hash, spaced, stored, text_chunks

MAGIC, BLOCK, PERCENTILE, CACHED_WORDS = b"PFOR0001", 512, 90, 1_000_000
_HEAD, _TAIL = struct.Struct("<IHBBH"), struct.Struct("<QQII8s")
_MANIFEST = "path string, first_doc long, n_docs long, n_ids long"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# ---- blocks


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Full blocks and one shorter last block, encoded."""
    full = len(ids) // BLOCK
    out = _pack(ids[: full * BLOCK].reshape(full, BLOCK)) if full else []
    return out + (_pack(ids[full * BLOCK :][None]) if len(ids) > full * BLOCK else [])


def _pack(rows: np.ndarray) -> list[bytes]:
    rows = rows.astype(np.uint32)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    n = rows.shape[1]
    at = min(n - 1, -(-n * PERCENTILE // 100) - 1)
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    out: list[bytes] = [b""] * len(rows)
    for w in map(int, np.unique(width)):
        mine = np.flatnonzero(width == w)
        value = np.zeros((-(-n // 64) * 64, len(mine)), np.uint64)
        value[:n] = rest[mine].T
        over = value >> np.uint64(w)
        value ^= over << np.uint64(w)
        value = value.reshape(-1, 64, len(mine))
        packed = np.zeros((len(value), w, len(mine)), np.uint64)
        for i in range(64 if w else 0):
            k, shift = divmod(i * w, 64)
            packed[:, k] |= value[:, i] << np.uint64(shift)
            if shift + w > 64:
                packed[:, k + 1] |= value[:, i] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(packed.reshape(-1, len(mine)).T.astype("<u8"))
        over = np.ascontiguousarray(over.T)
        for j, k in enumerate(mine):
            odd = np.flatnonzero(over[j])
            out[k] = _HEAD.pack(int(low[k]), n, w, 0, len(odd)) + packed[j].tobytes() + odd.astype("<u2").tobytes() + over[j][odd].astype("<u4").tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` of ``data``, which end where the next begins."""
    raw = np.frombuffer(data, np.uint8)
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    by: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, w, _, _) in enumerate(heads):
        by.setdefault((n, w), []).append(k)
    for (n, w), mine in by.items():
        groups = -(-n // 64)
        size = groups * w * 8
        body = np.array([int(starts[k]) + _HEAD.size for k in mine])
        packed = raw[body[:, None] + np.arange(size)].view("<u8").astype(np.uint64).T.reshape(groups, w, len(mine))
        value = np.zeros((groups, 64, len(mine)), np.uint64)
        for i in range(64 if w else 0):
            k, shift = divmod(i * w, 64)
            value[:, i] = packed[:, k] >> np.uint64(shift)
            if shift + w > 64:
                value[:, i] |= packed[:, k + 1] << np.uint64(64 - shift)
        value &= np.uint64((1 << w) - 1)
        got = np.ascontiguousarray(value.reshape(groups * 64, len(mine))[:n].T)
        for j, k in enumerate(mine):
            if odd := heads[k][4]:
                at = int(body[j]) + size
                got[j, np.frombuffer(data, "<u2", odd, at)] += np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(w)
        out[mine, :n] = got + np.array([heads[k][0] for k in mine], np.uint64)[:, None]
    return np.concatenate([out[k, : h[1]] for k, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32)


class ShardWriter:
    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.out, self.uri = fs.open_output_stream(path), uri
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.counts, self.rest, self.n = len(MAGIC), [], [], [], np.zeros(0, np.uint32), 0

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._write(ids[:whole])
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        blocks = pack_blocks(ids)
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))

    def close(self) -> tuple[str, int, int, int]:
        self._write(self.rest)
        docs = np.concatenate(self.docs).astype("<i8")
        self.out.write(np.array(self.starts, "<u8").tobytes() + docs.tobytes() + np.concatenate(self.counts).astype("<u4").tobytes())
        self.out.write(_TAIL.pack(self.at, self.n, len(self.starts), len(docs), MAGIC))
        self.out.close()
        return self.uri, int(docs[0]), len(docs), self.n


class ShardReader:
    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index, self.n_ids, blocks, docs, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        rest = self.file.read_at(size - _TAIL.size - index, index)
        self.starts = np.concatenate([np.frombuffer(rest, "<u8", blocks), np.array([index], "<u8")]).astype(np.int64)
        self.docs = np.frombuffer(rest, "<i8", docs, 8 * blocks)
        self.counts = np.frombuffer(rest, "<u4", docs, 8 * (blocks + docs)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard; only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return unpack_blocks(data, self.starts[a:b] - self.starts[a])[start - a * BLOCK : end - a * BLOCK]


# ---- ids


class WordIds:
    """Ids of texts, word by word through a bounded cache keyed by 64-bit hashes of the lower-cased words."""

    SLOTS = 1 << 21

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._clear()

    def _clear(self) -> None:
        self.key, self.value = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64)
        self.known = 1  # the first entry stands for the end of a text
        self.starts, self.counts = np.zeros(CACHED_WORDS + 1, np.int64), np.zeros(CACHED_WORDS + 1, np.int64)
        self.flat, self.used = np.array([self.end_id] + [0] * (1 << 16), np.uint32), 1
        self.counts[0] = 1

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 if it has none."""
        out, open_, slot = np.zeros(len(h), np.int64), np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) % self.SLOTS
        while len(open_):
            got = self.key[slot]
            hit = got == h[open_]
            out[open_[hit]] = self.value[slot[hit]]
            on = ~hit & (got != 0)
            open_, slot = open_[on], (slot[on] + 1) % self.SLOTS
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h >> np.uint64(20)).astype(np.int64) % self.SLOTS
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]
            mine = self.key[slot] == h
            self.value[slot[mine]] = entry[mine]
            h, entry, slot = h[~mine], entry[~mine], (slot[~mine] + 1) % self.SLOTS

    def _learn(self, h: np.ndarray, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.zeros(len(some), np.int64)
            np.cumsum([len(w) + 1 for w in some[:-1]], out=begins[1:])
            ids = np.array(code.ids, np.uint32)
            place = np.fromiter((a for a, _ in code.offsets), np.int64, len(ids))
            n = np.bincount(np.searchsorted(begins, place, side="right") - 1, minlength=len(some))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            k = self.known
            self.counts[k : k + len(some)] = n
            self.starts[k : k + len(some)] = self.used + np.cumsum(n) - n
            self._insert(h[i : i + 1000], np.arange(k, k + len(some)))
            self.used += len(ids)
            self.known += len(some)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after each text, number of ids of each text)."""
        if _has_special(data):  # only the library may look for its special tokens
            codes = self.tokenizer.encode_batch([bytes(data[a:b]).decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)
            return np.array([i for c in codes for i in [*c.ids, self.end_id]], np.uint32), np.array([len(c.ids) + 1 for c in codes])
        text, begins = spaced(ascii_lower(data), offs)
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = (text != 32) & (text != 10)
        letter = np.zeros(len(text) + 1, bool)
        letter[1:] = (text - np.uint8(97)) < 26
        alone = ((text == 46) | (text == 44)) & letter[:-1] & ~inside[2:]  # a full stop or comma that ends a word is a piece of its own
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | alone))
        alone = np.append(alone[1:], False)
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | alone)) + 1
        h = range_hash(prefix_hash(text), start, end) | np.uint64(1)
        at = self._find(h)
        if (missing := np.flatnonzero(at == 0)).size:
            new, where = np.unique(h[missing], return_index=True)
            if self.known + len(new) > CACHED_WORDS:
                self._clear()
                missing = np.arange(len(h))
                new, where = np.unique(h, return_index=True)
            if len(new) >= CACHED_WORDS:  # more than the cache holds: by halves, one text without it
                m = len(offs) // 2
                if len(offs) == 2:
                    ids = np.array([*self.tokenizer.encode(bytes(data).decode(), add_special_tokens=False).ids, self.end_id], np.uint32)
                    return ids, np.array([len(ids)])
                parts = [self.encode(data[: offs[m]], offs[: m + 1]), self.encode(data[offs[m] :], offs[m:] - offs[m])]
                return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            raw = text.tobytes()
            first = missing[where]
            self._learn(new, [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            at[missing] = self._find(h[missing])
        w = np.searchsorted(start, begins)
        every = np.zeros(len(at) + len(offs) - 1, np.int64)
        ends = w[1:] + np.arange(len(offs) - 1)
        rest = np.ones(len(every), bool)
        rest[ends] = False
        every[rest] = at
        n = self.counts[every]
        before = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.starts[every] - before, n) + np.arange(int(n.sum()))]
        return ids, np.diff(before[ends] + 1, prepend=0)


_SPECIAL = re.compile(rb"<\|(startof|endof)text\|>", re.IGNORECASE)


def _has_special(data: np.ndarray) -> bool:
    return _SPECIAL.search(data.tobytes()) is not None


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- Spark


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes shards and returns their manifest (path, first_doc, n_docs, n_ids), itself stored in the shared folder."""
    folder, tokenizer = folder or new_folder(docs.sparkSession, "token-files"), tokenizer or default_tokenizer()
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for ids, data, offs in text_chunks(batches):
            shard = shard or ShardWriter(f"{folder}/shard-{uuid.uuid4().hex}.pfor")
            got, counts = _encoder(tokenizer, end_id).encode(data, offs)
            shard.add(ids, counts, got)
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in shard.close()], ["path", "first_doc", "n_docs", "n_ids"])

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = ShardReader(path)
                ends = np.cumsum(shard.counts)
                at = 0
                while at < len(ends):
                    first = int(ends[at] - shard.counts[at])
                    to = max(at + 1, int(np.searchsorted(ends, first + (1 << 19), side="right")))
                    raw = memoryview(shard.ids(first, int(ends[to - 1])).astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (int(ends[k] - shard.counts[k]) - first) : 4 * (int(ends[k]) - first)]) for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.docs[at:to]), pa.array(base + ends[at:to] - shard.counts[at:to]), pa.array(shard.counts[at:to]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to

    placed = manifest.selectExpr("path", "coalesce(sum(n_ids) over (order by first_doc rows between unbounded preceding and 1 preceding), 0) as base")
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(manifest: DataFrame, start: int, end: int) -> DataFrame:
    """(position, ids) of the global id range [start, end): one row per shard that holds a part of it; other blocks are not read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, n in zip(*(batch.column(k).to_pylist() for k in ("path", "base", "n_ids")), strict=True):
                a, b = max(start, base), min(end, base + n)
                got = ShardReader(path).ids(a - base, b - base)
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([got.tolist()], pa.list_(pa.int64()))], ["position", "ids"])

    placed = manifest.selectExpr("path", "n_ids", "coalesce(sum(n_ids) over (order by first_doc rows between unbounded preceding and 1 preceding), 0) as base")
    return placed.where((F.col("base") < end) & (F.col("base") + F.col("n_ids") > start)).mapInArrow(read, "position long, ids array<long>")
