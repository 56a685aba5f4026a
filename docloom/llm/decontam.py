"""Benchmark decontamination by the q-gram lemma.

A document holds a benchmark item when some region of it is within ``budget`` edits of the item, both lower-cased in
ASCII with white space runs as one space; the budget is floor(6 % of the item's bytes).

1. Filter. With k edits an item of n characters keeps at least n + 1 - q - k * q of its q-grams (q = 10) in any such
   region, on diagonals (place in the document minus place in the item) at most k apart. Every q-gram of a document
   that also is one of the items' is a match; matches are counted in diagonal bands of width 2k + 2 that begin every
   k + 1 diagonals, so bands overlap and any region lies within one of them.
2. Bands that reach the bound are retained; touching bands of one item are one region.
3. Verification. A banded alignment of the whole item against the region (free ends in the region) gives the least
   number of edits, or none within the budget. Q-grams are compared by 64-bit hashes, the alignment by bytes.

With 6 % and q = 10 the bound is positive from 16 bytes on wherever the budget is above zero; where it would not be,
the budget is zero. Items under 10 bytes have no q-gram and are looked for as they are.

The items are one small table, sent to the tasks when their text is within ``broadcast_bytes`` (64 MB, checked);
beyond it the documents are compared with one slice of about that size after the other, each written before the next
is read, so the same rows result and the driver holds one slice. A gram's consecutive places in an item (a run of one
character) are one entry, and matches are counted some at a time, so no text makes more than a bounded number at once.

Nulls, empty texts and blank items match nothing. An item_id that repeats counts once for each text. Rows that
repeat a doc_id each give their rows; ``clean`` drops all rows of a doc_id that has a match. Ties: the region with
the fewest edits, then the one that ends first, then the shortest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ASCII_SPACE, ascii_lower, id_text, prefix_hash, range_hash, spaced, stored, text_chunks, unused

Q, RATE, BROADCAST_BYTES, MATCHES = 10, 0.06, 64 << 20, 1 << 19
_SCHEMA = "doc_id long, item_id long, start long, end long, edits long, item_bytes long"


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, white space runs as one space and none at the ends, and where each begins (one space stands between texts)."""
    text, begins = spaced(ascii_lower(data), offs)
    blank = ASCII_SPACE[text]
    keep = ~blank | np.append(False, ~blank[:-1])
    keep[begins[:-1]] &= ~blank[begins[:-1]]
    text = np.where(blank, np.uint8(32), text)[keep]
    return text, np.append(0, np.cumsum(keep))[begins]


def grams(text: np.ndarray) -> np.ndarray:
    """Hashes of the q-grams at all places."""
    at = np.arange(max(0, len(text) - Q + 1))
    return range_hash(prefix_hash(text), at, at + Q)


def budget(n: int, rate: float = RATE) -> int:
    k = int(rate * n)
    return k if n + 1 - Q - k * Q > 0 else 0


def least_edits(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item within the region, if it has at most k edits.

    Row i holds the cells on diagonals -k to len(region) - len(item) + k: no other cell is within k edits of a start.
    A cell is edits * 2**32 + (len(region) - start), so the start is carried along and shorter regions win ties.
    """
    m, n = len(item), len(region)
    width, one = max(n - m, 0) + 2 * k + 1, np.int64(1) << 32
    never = one << 20
    place = np.arange(width, dtype=np.int64) - k
    row = np.where((place >= 0) & (place <= n), n - place, never)
    padded = np.full(m + width, -1, np.int16)
    padded[k : min(len(padded), k + n)] = region[: max(0, len(padded) - k)]
    step = np.arange(width, dtype=np.int64) * one
    for i in range(m):
        there = padded[i : i + width]
        across = row + np.where(there == item[i], 0, np.where(there < 0, never, one))
        across[:-1] = np.minimum(across[:-1], row[1:] + one)
        row = np.minimum.accumulate(across - step) + step
        row[place + i + 1 > n] = never
        if int(row.min()) >= (k + 1) * one:
            return None
    best = int((row >> 32).argmin())  # the fewest edits, then the earliest end, then the shortest region
    return int(row[best] >> 32), int(n - (row[best] & (one - 1))), int(place[best]) + m


class Items:
    """Benchmark items by q-gram."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts, self.k = [], [], []
        gram, item, place = [], [], []
        for i, raw in rows:
            data = np.frombuffer(raw.encode(), np.uint8)
            text, ends = normalised(data, np.array([0, len(data)]))
            text = text[: max(0, int(ends[1]) - 1)]
            if not len(text):
                continue
            g = grams(text) if len(text) >= Q else np.zeros(0, np.uint64)
            gram.append(g)
            item.append(np.full(len(g), len(self.ids)))
            place.append(np.arange(len(g)))
            self.ids.append(i)
            self.texts.append(text)
            self.k.append(budget(len(text)))
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.lexsort((place, item, gram))
        gram, item, place = gram[order].astype(np.uint64), item[order], place[order]
        # a gram's places in one item as runs of consecutive ones: a run of one character is one entry
        new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)[: max(0, len(gram) - 1)])) if len(gram) else np.zeros(0, np.int64)
        self.gram, self.item, self.place = gram[new], item[new], place[new]
        self.run = np.diff(np.append(new, len(gram)))
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self._slot(self.gram)] = True
        self.k = np.array(self.k, np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.short = [j for j in range(len(self.ids)) if self.size[j] < Q]

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _bands(self, at: np.ndarray, low: np.ndarray, count: np.ndarray, begins: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(code of document, item and band, matches in it) for places with ``count`` entries from ``low`` on."""
        hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        at = np.repeat(at, count)
        item, first, last = self.item[hit], self.place[hit], self.place[hit] + self.run[hit] - 1
        key = ((np.searchsorted(begins, at, side="right") - 1) * len(self.ids) + item) * span
        step, base = self.k[item] + 1, at + self.size[item]
        lower, upper = (base - last) // step, (base - first) // step
        n = upper - lower + 1
        each = np.repeat(np.arange(len(at)), n)
        band = lower[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        top = base[each] - band * step[each]  # the last place of this band's step; the first is step - 1 before it
        number = np.minimum(last[each], top) - np.maximum(first[each], top - step[each] + 1) + 1
        code = key[each] + band + 1  # bands count from 1
        # a band covers two steps: each match counts in its own and in the one before
        code, where = np.unique(np.concatenate([code, code - 1]), return_inverse=True)
        return code, np.bincount(where.ravel(), np.concatenate([number, number]), len(code)).astype(np.int64)

    def regions(self, text: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item, start, end) of the retained regions."""
        g = grams(text)
        if not len(g) or not len(self.gram):
            return []
        at = np.flatnonzero(self.known[self._slot(g)])
        low, high = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        span = len(text) + int(self.size.max()) + 3
        codes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends, i = np.cumsum(count), 0
        while i < len(at):  # some matches at a time: only their counts by band stay
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MATCHES, side="right")))
            code, number = self._bands(at[i:j], low[i:j], count[i:j], begins, span)
            codes.append(code)
            numbers.append(number)
            i = j
        both, where = np.unique(np.concatenate(codes), return_inverse=True)
        number = np.bincount(where.ravel(), np.concatenate(numbers), len(both)).astype(np.int64)
        item = both // span % len(self.ids)
        enough = number >= (self.size + 1 - Q - self.k * Q)[item]
        out: list[tuple[int, int, int, int]] = []
        for code in both[enough].tolist():
            (d, j), b = divmod(code // span, len(self.ids)), code % span
            k, n = int(self.k[j]), int(self.size[j])
            a = (b - 1) * (k + 1) - n
            lo, hi = max(int(begins[d]), a - k), min(int(begins[d + 1]) - 1, a + 2 * (k + 1) + n + k)
            if out and out[-1][:2] == (d, j) and lo <= out[-1][3]:
                out[-1] = (d, j, out[-1][2], max(hi, out[-1][3]))
            else:
                out.append((d, j, lo, hi))
        return out

    def found(self, text: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item, start, end, edits) of verified regions, the best of each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, j, lo, hi in self.regions(text, begins):
            if (got := least_edits(self.texts[j], text[lo:hi], int(self.k[j]))) is not None:
                e, a, b = got
                base = lo - int(begins[d])
                best[d, j] = min(best.get((d, j), (1 << 40, 0, 0)), (e, base + a, base + b))
        for j in self.short:
            raw, want = text.tobytes(), self.texts[j].tobytes()
            for d in range(len(begins) - 1):
                if (p := raw.find(want, int(begins[d]), int(begins[d + 1]) - 1)) >= 0:
                    best[d, j] = (0, p - int(begins[d]), p - int(begins[d]) + len(want))
        for (d, j), (e, a, b) in sorted(best.items()):
            yield d, j, a, b, e


def _finder(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Items(items)
        for ids, data, offs in text_chunks(batches):
            text, begins = normalised(data, offs)
            rows = [(int(ids[d]), table.ids[j], a, b, e, int(table.size[j])) for d, j, a, b, e in table.found(text, begins)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "item_bytes"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_bytes): a row for each document and item it holds. start and end count bytes of the normalised text."""
    items = id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + total // broadcast_bytes
    if slices > 1:
        items = stored(items, "benchmark-items")
    out = None
    for k in range(slices):
        some = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toLocalIterator()]
        found = id_text(docs).mapInArrow(_finder(some), _SCHEMA)
        if slices > 1:  # written before the next slice is read, so the driver holds one slice at a time
            found = stored(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    name = unused(docs, "bad_id")
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")
