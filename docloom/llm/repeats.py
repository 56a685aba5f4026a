"""Repeated passages: a suffix array in pieces, scanned for its common-prefix interval tree.

``removed_repeats`` removes each byte covered by a 50-byte string that also starts in a document with a smaller
doc_id. ``maximal_repeats`` lists the maximal repeat groups with all their occurrences.

The corpus is cut by content, so that equal strings meet without sorting every suffix of it:

1. A window is 50 bytes. Its anchor is the 16-byte gram with the least hash in it (leftmost in a tie), so equal
   windows have equal anchors at equal offsets. Consecutive windows with one anchor form a segment, some 18 windows
   and up to 84 bytes. Every segment is a row (gram hash, segment hash, document, start, windows); rows travel in
   column blocks, after repeats within an input batch have been settled there.
2. A segment whose bytes occur in a smaller document is removed whole. What is left of a gram with several
   different segments is undecided: the edges of repeats.
3. The undecided segments of a gram form a bucket. Its suffixes (one for each window, to the segment's end) are
   sorted, common prefixes of neighbours are measured, and a stack scan yields each interval of the common-prefix
   tree of 50 bytes or more with all its members. Intervals whose members have different bytes to the left (or
   begin their segment) are maximal repeat groups; a group that only has one left neighbour lies within the group
   one byte before it. In each group, members of a larger doc_id than the least lose the group's bytes.

A bucket holds each different segment of a gram once for each batch of input, not once for each copy.
Grams and segments are compared by hashes of 64 and 48 bits; the suffixes themselves by their bytes.

Nulls and texts under 50 bytes lose nothing. Each row gives a result. Rows of one doc_id, with one text or several, are
one document: they take nothing from each other, and all of their strings take from documents with a larger doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import id_text, mix, powers, prefix_hash, range_hash, stored, text_chunks

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
WIDEST = LENGTH + SPAN - 1
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 23
_BLOCKS = "bucket int, block binary"


# ---- column blocks


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _whole(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def to_blocks(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of int64 columns as one compressed block for each bucket; the first column is put in order."""
    order = np.lexsort((columns[0], bucket))
    bucket, columns = bucket[order], [c[order].astype(np.int64) for c in columns]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    keys, blocks = bucket[edges], []
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        body = b""
        for k, c in enumerate(columns):
            low = int(c[a:b].min())
            x = (c[a:b] - low).astype(np.uint64) if k else np.diff(c[a:b].astype(np.uint64), prepend=np.uint64(0))
            size = max(1, -(-int(x.max()).bit_length() // 8))
            body += np.array([0 if k == 0 else low, size], "<i8").tobytes() + _planes(x, size)
        blocks.append(np.array([b - a, len(body)], "<i8").tobytes() + pa.compress(body, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])


def from_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, columns) of each bucket in a partition that is ordered by bucket."""

    def decoded(block: bytes) -> list[np.ndarray]:
        n, size = np.frombuffer(block, "<i8", 2)
        body, at, out = pa.decompress(block[16:], int(size), "zstd", asbytes=True), 0, []
        for k in range(width):
            low, planes = np.frombuffer(body, "<i8", 2, at)
            x = _whole(body[at + 16 : at + 16 + int(planes * n)], int(n), int(planes))
            out.append(np.cumsum(x).view(np.int64) if k == 0 else x.view(np.int64) + low)
            at += 16 + int(planes * n)
        return out

    now, parts = None, []
    for batch in batches:
        for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parts and key != now:
                yield now, [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            now = key
            parts.append(decoded(block))
    if parts:
        yield now, [np.concatenate(x) for x in zip(*parts, strict=True)]


# ---- 1: segments


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first window's place in the text, windows, gram hash, segment hash) of all segments."""
    parts = []
    if len(data) > _PIECE and len(offs) == 2:  # a very long text, in pieces that share 49 bytes
        for a in range(0, len(data) - LENGTH + 1, _PIECE - LENGTH + 1):
            piece = data[a : a + _PIECE]
            got = segments(piece, np.array([0, len(piece)]))
            parts.append((got[0], got[1] + a, *got[2:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(data) - LENGTH + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = prefix_hash(data)
    gram = mix((h[GRAM:] - h[:-GRAM]) * powers(len(h))[1][: len(data) - GRAM + 1])
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n], low[SPAN - 32 : SPAN - 32 + n])
    anchor = (low & _PLACE).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        ok[a : max(a, b - LENGTH + 1)] = True
    new = ok[:n].copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[: n - 1]
    first = np.flatnonzero(new)
    begins = offs[:-1][offs[:-1] < n]
    first = np.union1d(first, begins[ok[begins]])
    text = np.searchsorted(offs, first, side="right") - 1
    bound = np.append(first[1:], n)
    last = np.minimum(bound, np.maximum(offs[text + 1] - LENGTH + 1, first + 1))
    return text, first - offs[text], last - first, gram[anchor[first]].view(np.int64), (range_hash(h, first, last + LENGTH - 1) >> np.uint64(16)).astype(np.int64)


def settle(gram: np.ndarray, seg: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by gram, segment, document; whether each row's segment occurs in a smaller document)."""
    order = np.lexsort((doc, seg, gram))
    g, s, d = gram[order], seg[order], doc[order]
    first = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])) if len(g) else np.zeros(0, bool)
    least = d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))] if len(d) else d
    return order, d > least


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    size = int(end.max()) + 2
    code = np.unique(doc, return_inverse=True)[1] * size
    far = np.maximum.accumulate(code + end)
    new = np.append(True, code[1:] + start[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.append(far[at[1:] - 1], far[-1]) - code[at]


def _bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mix(x.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _segment_blocks(n_buckets: int):
    """Segments that an input batch cannot settle (mark 0) and ranges that it can (mark 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch | None:
            if not held:
                return None
            doc, start, n, gram, seg = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(doc):
                return None
            order, done = settle(gram, seg, doc)
            some, rest = order[done], order[~done]
            d, a, b = joined(doc[some], start[some], start[some] + n[some] + LENGTH - 1)
            key = mix(d.view(np.uint64)).view(np.int64)
            columns = [np.concatenate(x) for x in zip((gram[rest], seg[rest], doc[rest], start[rest], n[rest], np.zeros(len(rest), np.int64)), (key, np.zeros(len(d), np.int64), d, a, b - a, np.ones(len(d), np.int64)), strict=True)]
            return to_blocks(_bucket_of(columns[0], n_buckets), columns)

        size = 0
        for batch in batches:
            done = 0
            for ids, data, offs in text_chunks(iter([batch])):
                base = batch.column(2).slice(done, len(ids)).to_numpy()
                done += len(ids)
                text, start, n, gram, seg = segments(data, offs)
                held.append((ids[text], start + base[text], n, gram, seg))
                size += len(text)
                if size >= 1_000_000:
                    if (out := flush()) is not None:
                        yield out
                    size = 0
        if (out := flush()) is not None:
            yield out

    return run


# ---- 2: settled ranges and undecided segments


def undecided(gram: np.ndarray, seg: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows in order of gram and segment, one for each document's first occurrence: those whose gram has several documents."""
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    return np.repeat(low != high, np.diff(np.append(first, len(gram))))


def _sort_out(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (gram, seg, doc, start, n, mark) in from_blocks(batches, 6):
            was = mark == 1
            out = [(doc[was], start[was], n[was], np.zeros(int(was.sum()), np.int64), np.ones(int(was.sum()), np.int64))]
            gram, seg, doc, start, n = (x[~was] for x in (gram, seg, doc, start, n))
            if len(gram):
                order, done = settle(gram, seg, doc)
                some = order[done]
                d, a, b = joined(doc[some], start[some], start[some] + n[some] + LENGTH - 1)
                out.append((d, a, b - a, np.zeros(len(d), np.int64), np.ones(len(d), np.int64)))
                rest = order[~done]
                rest = rest[undecided(gram[rest], seg[rest], doc[rest])]
                out.append((doc[rest], start[rest], n[rest], gram[rest], np.zeros(len(rest), np.int64)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(columns[0]):
                yield to_blocks(_bucket_of(columns[0], n_buckets), columns)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ranges, open): settled [start, end) pairs, and (gram, start, windows) of undecided segments."""
    for _, (doc, start, n, gram, mark) in from_blocks(batches, 5):
        d, a, b = joined(doc[mark == 1], start[mark == 1], start[mark == 1] + n[mark == 1])
        pairs = np.stack([a, b], axis=1).astype("<i8")
        rest = np.flatnonzero(mark == 0)
        rest = rest[np.lexsort((start[rest], doc[rest]))]
        rd, triples = doc[rest], np.stack([gram[rest], start[rest], n[rest]], axis=1).astype("<i8")
        ids = np.union1d(d, rd)
        x, y = (np.searchsorted(z, np.append(ids, np.iinfo(np.int64).max)) for z in (d, rd))
        for i in range(0, len(ids), 5000):
            some = range(i, min(i + 5000, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 5000]), pa.array([pairs[x[k] : x[k + 1]].tobytes() for k in some], pa.binary()), pa.array([triples[y[k] : y[k + 1]].tobytes() if y[k + 1] > y[k] else None for k in some], pa.binary())], ["doc_id", "ranges", "open"])


# ---- 3: suffix arrays


def _open_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, start, bytes) of undecided segments, from (doc_id, text, base, open)."""
    for batch in batches:
        gram, doc, start, bodies = [], [], [], []
        for i, text, base, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
            buffer = text.as_buffer()
            for g, s, n in np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, 3).tolist():
                if not 0 <= s - base < len(buffer):  # in another text of this doc_id
                    continue
                gram.append(g)
                doc.append(i)
                start.append(s)
                bodies.append(buffer[s - base : s - base + n + LENGTH - 1].to_pybytes())
            if len(gram) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(start), pa.array(bodies, pa.binary())], ["gram", "doc_id", "start", "bytes"])
                gram, doc, start, bodies = [], [], [], []
        if gram:
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(start), pa.array(bodies, pa.binary())], ["gram", "doc_id", "start", "bytes"])


def prefix_intervals(common: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(prefix length, first, last) of the interval tree of a suffix array; common[i] is what entries i - 1 and i share (0 where under the least length, and at both ends)."""
    size, first, last = [], [], []
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, len(common)):
        c, left = common[i], i - 1
        while stack[-1][0] > c:
            s, left = stack.pop()
            size.append(s)
            first.append(left)
            last.append(i - 1)
        if stack[-1][0] < c:
            stack.append((c, left))
    return size, first, last


def repeat_groups(bodies: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal repeat groups among segments: (group, bytes, segment number, window in the segment) of all occurrences."""
    n = np.array([len(b) - LENGTH + 1 for b in bodies])
    raw = np.zeros((len(bodies) + 1, WIDEST), np.uint8)
    for k, b in enumerate(bodies):
        raw[k, : len(b)] = np.frombuffer(b, np.uint8)
    raw = raw.reshape(-1)
    owner = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    head = raw[(owner * WIDEST + window)[:, None] + np.arange(LENGTH)]
    # only suffixes whose first bytes are not alone need an order
    code = head.view(f"S{LENGTH}").ravel()
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    keep = np.append(same, False) | np.append(False, same)
    order = order[keep]
    owner, window = owner[order], window[order]
    length = n[owner] + LENGTH - 1 - window
    suffix = raw[np.minimum((owner * WIDEST + window)[:, None] + np.arange(WIDEST), len(raw) - 1)]
    suffix[np.arange(WIDEST)[None, :] >= length[:, None]] = 0
    order = np.argsort(suffix.view(f"S{WIDEST}").ravel(), kind="stable")
    owner, window, length, suffix = owner[order], window[order], length[order], suffix[order]
    if not len(owner):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    other = suffix[1:] != suffix[:-1]
    common = np.where(other.any(axis=1), other.argmax(axis=1), WIDEST)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    common = np.concatenate([[0], np.where(common >= LENGTH, common, 0), [0]])
    size, first, last = (np.array(x, np.int64) for x in prefix_intervals(common.tolist()))
    left = np.where(window > 0, raw[owner * WIDEST + window - 1].astype(np.int64), -1)
    change = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0))])
    diverse = change[last] > change[first]
    size, first, last = size[diverse], first[diverse], last[diverse]
    count = last - first + 1
    group = np.repeat(np.arange(len(size)), count)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return group, size[group], owner[at], window[at]


def _buckets(batches: Iterator[pa.RecordBatch], most: int = 4_000) -> Iterator[tuple]:
    """The columns (gram, numbers..., bytes) of whole grams of a partition in gram order, some thousand segments at a time."""
    held: list[pa.RecordBatch] = []

    def some(t: pa.Table):
        return (*(t.column(k).to_numpy() for k in range(t.num_columns - 1)), t.column(t.num_columns - 1).to_pylist())

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            t = pa.Table.from_batches(held)
            gram = t.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            for a in _cuts(gram[:cut], most):
                yield some(t.slice(*a))
            held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        for a in _cuts(t.column(0).to_numpy(), most):
            yield some(t.slice(*a))


def _cuts(gram: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(gram):
        to = min(len(gram), at + most)
        if to < len(gram):
            back = int(np.searchsorted(gram, gram[to]))
            to = back if back > at else int(np.searchsorted(gram, gram[to], side="right"))
        yield at, to - at
        at = to


def _repeated_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, doc, start, bodies in _buckets(batches):
        group, size, owner, window = repeat_groups(bodies, doc)
        if not len(group):
            continue
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(np.minimum.reduceat(doc[owner], first), np.diff(np.append(first, len(group))))
        lost = doc[owner] > least
        at = start[owner[lost]] + window[lost]
        d, a, b = joined(doc[owner[lost]], at, at + size[lost])
        edges = np.flatnonzero(np.diff(d, prepend=-1)) if len(d) else np.zeros(0, np.int64)
        pairs = np.stack([a, b], axis=1).astype("<i8")
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d[edges]), pa.array([x.tobytes() for x in np.split(pairs, edges[1:])], pa.binary())], ["doc_id", "ranges"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for gram, doc, start, bodies in _buckets(batches):
        group, size, owner, window = repeat_groups(bodies, doc)
        if len(group):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            name = np.repeat([f"{int(gram[owner[k]]) & (2**64 - 1):016x}-{int(start[owner[k]])}-{int(doc[owner[k]])}-{int(window[k])}-{int(size[k])}" for k in first], np.diff(np.append(first, len(group))))
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(size), pa.array(doc[owner]), pa.array(start[owner] + window)], ["repeat", "n_bytes", "doc_id", "start"])


def _own(parts: pa.Scalar, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of one text of n bytes that begins at ``base`` among its document's."""
    pairs = np.frombuffer(b"".join(parts.as_py() or []) if parts.is_valid else b"", "<i8").reshape(-1, 2)
    _, a, b = joined(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    a, b = np.clip(a - base, 0, n), np.clip(b - base, 0, n)
    return a[b > a], b[b > a]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, base, list of ranges) to the result's rows."""
    for batch in batches:
        rows: list[tuple] = []
        for i, text, base, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
            body = bytes(text.as_buffer())
            a, b = _own(parts, base, len(body))
            digest, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                digest.update(body[at:x])
                at = y
            digest.update(body[at:])
            rows.append((i, len(body), int((b - a).sum()), len(a), digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


# ---- Spark


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): base is where a text begins among the different texts of its doc_id, in order of their hashes."""
    texts = id_text(docs).withColumn("hash", F.xxhash64("text"))
    twice = texts.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc_id")
    if twice.isEmpty():
        return texts.select("doc_id", "text", F.lit(0).cast("long").alias("base"))
    several = texts.join(twice, "doc_id", "left_semi").groupBy("doc_id", "hash").agg(F.max(F.octet_length("text")).alias("n"))
    several = several.selectExpr("doc_id", "hash", "coalesce(sum(n) over (partition by doc_id order by hash rows between unbounded preceding and 1 preceding), 0) as base")
    return stored(texts.join(several, ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("base", F.lit(0)).cast("long").alias("base")), "placed-texts")


def _n_buckets(texts: DataFrame) -> int:
    """Buckets of some 16 MB of text, and as many as there are shuffle partitions at least."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 24)


def _decided(texts: DataFrame) -> DataFrame:
    """(doc_id, ranges, open) of documents with a repeat."""
    n = _n_buckets(texts)
    blocks = texts.mapInArrow(_segment_blocks(n), _BLOCKS).repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_out(n), _BLOCKS)
    return blocks.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_document, "doc_id long, ranges binary, open binary")


def _suffix_buckets(texts: DataFrame, decided: DataFrame) -> DataFrame:
    open_ = texts.join(decided.where("open is not null").select("doc_id", "open"), "doc_id").select("doc_id", "text", "base", "open")
    return open_.mapInArrow(_open_segments, "gram long, doc_id long, start long, bytes binary").repartition("gram").sortWithinPartitions("gram")


def removed_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row; see the module's docstring."""
    texts = _placed(docs)
    decided = stored(_decided(texts), "repeat-ranges")
    more = _suffix_buckets(texts, decided).mapInArrow(_repeated_ranges, "doc_id long, ranges binary")
    ranges = decided.select("doc_id", "ranges").unionByName(more).groupBy("doc_id").agg(F.collect_list("ranges").alias("parts"))
    return texts.join(ranges, "doc_id", "left").select("doc_id", "text", "base", "parts").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(repeat, n_bytes, doc_id, start): every occurrence of every maximal repeat group at the undecided edges of repeated passages."""
    texts = _placed(docs)
    return _suffix_buckets(texts, _decided(texts)).mapInArrow(_listed, "repeat string, n_bytes long, doc_id long, start long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repeated bytes gone; bytes that no longer form a character are dropped with them."""
    texts = _placed(docs)
    decided = stored(_decided(texts), "repeat-ranges")
    more = _suffix_buckets(texts, decided).mapInArrow(_repeated_ranges, "doc_id long, ranges binary")
    ranges = decided.select("doc_id", "ranges").unionByName(more).groupBy("doc_id").agg(F.collect_list("ranges").alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, parts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                body = np.frombuffer(text.as_buffer() or b"", np.uint8)
                keep = np.ones(len(body), bool)
                for a, b in zip(*_own(parts, base, len(body)), strict=True):
                    keep[a:b] = False
                out.append(body[keep].tobytes().decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return texts.join(ranges, "doc_id", "left").select("doc_id", "text", "base", "parts").mapInArrow(cut, "doc_id long, text string")


#: DuckDB SQL for ``removed_repeats``: all windows of 50 bytes by hash, and runs of those that a smaller doc_id has.
ORACLE_SQL = """
with given as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, 512 * k as base, least(512, length(h) // 2 - 49 - 512 * k) as n, substring(h, 1024 * k + 1, 1122) as b from given, unnest(range(greatest(0, (length(h) // 2 - 49 + 511) // 512))) as t(k)),
windows as (select doc_id, base + i as i, hash(substring(b, 2 * i + 1, 100)) as w from blocks, unnest(range(n)) as t(i)),
least_doc as (select w, min(doc_id) as least from windows group by w),
gone as (select doc_id, i from windows join least_doc using (w) where least < doc_id),
marked as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from gone),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
edges as (select doc_id, b as a, coalesce(lead(a) over (partition by doc_id order by a), 1000000000) as b from (select * from runs union all select doc_id, -1, 0 from given))
select g.doc_id, length(h) // 2 as n_bytes, coalesce(r.n_removed, 0)::bigint as n_removed, coalesce(r.n_spans, 0)::bigint as n_spans, sha256(unhex(k.kept)) as kept_sha256
from given g left join (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id) r using (doc_id)
join (select e.doc_id, string_agg(substring(h, 2 * e.a + 1, 2 * (e.b - e.a)), '' order by e.a) as kept from edges e join given using (doc_id) group by e.doc_id) k using (doc_id)
"""
