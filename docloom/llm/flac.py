"""FLAC media columns: lossless 8-bit mono streams, encoded, checked and decoded frame by frame.

A payload is stored as unsigned bytes shifted to signed 8-bit samples (byte - 128), in frames of 576 samples:

* a stream header with STREAMINFO (sizes, sample count, MD5 of the samples) and a SEEKTABLE of every ``SEEK`` frames
  (first sample, byte offset from the first frame, samples), so a reader can start at any sample;
* frames with a CRC-8 over their header and a CRC-16 over the whole frame;
* one subframe each: constant, verbatim, a fixed linear predictor of order 0 to 4, or a quantised linear predictor,
  with Rice-coded residuals (four partitions, 4-bit parameters).

The decoder reads residuals of many frames in step, one residual of each at a time, undoes the predictor, and
raises ValueError where a CRC, the sample count or the MD5 does not fit. Streams of other encoders are decoded as far
as they are mono, 8-bit, of fixed block size 576 and with 4-bit Rice parameters.

``encode`` adds a media column, ``decode`` gives the payload back with features, ``pcm_blocks`` writes rows of decoded
blocks with their sample offset, ``seek`` decodes from any sample on. A null text is the empty text and gives one
frame of padding; equal texts give equal bytes; rows that repeat a doc_id stay rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import binary_rows, id_text, text_chunks

BLOCK, RATE, SEEK, PARTS = 576, 16_000, 64, 4
_PART = BLOCK // PARTS
_MAX_RICE = 14


def _crc_table(poly: int, bits: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        x = np.where(x & (1 << (bits - 1)), (x << 1) ^ poly, x << 1) & ((1 << bits) - 1)
    return x.astype(np.uint16 if bits > 8 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc(rows: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC of the first ``sizes`` bytes of each row; all rows in step."""
    order = np.argsort(-sizes, kind="stable")
    columns, value = np.ascontiguousarray(rows[order].T), np.zeros(len(rows), table.dtype)
    left = np.searchsorted(-sizes[order], -np.arange(len(columns)), side="left")
    wide = table.dtype == np.uint16
    for i in range(int(sizes.max(initial=0))):
        n = left[i]
        v = value[:n]
        value[:n] = ((v << np.uint16(8)) ^ table[(v >> np.uint16(8)).astype(np.uint8) ^ columns[i, :n]]) if wide else table[v ^ columns[i, :n]]
    out = np.empty_like(value)
    out[order] = value
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room >>= 1
    return bytes([(~room << 1) & 0xFF | n, *reversed(tail)])


# ---- encoding


class _Bits:
    """Bit fields of many rows, each row growing by its own widths, as sums of shifted values in 64-bit words."""

    def __init__(self, rows: int, words: int):
        self.words = np.zeros((rows, words + 1), np.uint64)
        self.at = np.zeros(rows, np.int64)
        self.row = np.arange(rows)

    def put(self, value: np.ndarray, width: np.ndarray) -> None:
        """Appends values of up to 32 bits; width 0 appends nothing."""
        word, used = self.at >> 6, self.at & 63
        over = used + width - 64
        v = value.astype(np.uint64)
        up = np.maximum(-over, 0).astype(np.uint64)
        down = np.maximum(over, 0).astype(np.uint64)
        self.words[self.row, word] |= (v >> down) << up
        if (over > 0).any():
            some = np.flatnonzero(over > 0)
            self.words[some, word[some] + 1] |= v[some] << (np.uint64(64) - down[some])
        self.at += width


def _fold(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, x << 1, ~x * 2 + 1).astype(np.uint32)


def _rice(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, about how many bits) of each row's Rice code, from the mean."""
    total = folded.sum(axis=1, dtype=np.int64)
    k = np.clip(np.rint(np.log2(np.maximum(total, 1) / folded.shape[1] * 0.69)), 0, 10).astype(np.int64)
    return k, (total >> k) + folded.shape[1] * (k + 1)


def _predicted(x: np.ndarray) -> list[np.ndarray]:
    """Residuals of the fixed predictors of order 0 to 4, with the warm-up samples in front."""
    out, d = [x], x
    for order in range(1, 5):
        d = np.diff(d, axis=1)
        out.append(np.concatenate([x[:, :order], d], axis=1))
    return out


_SHIFT, _LPC_ORDER, _PRECISION = 6, 2, 9


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients, residuals) of the least-squares predictor of order 2 of each row."""
    f = x.astype(np.float64)
    a0, a1, a2 = (f[:, 2:] ** 2).sum(axis=1), (f[:, 1:-1] * f[:, 2:]).sum(axis=1), (f[:, :-2] * f[:, 2:]).sum(axis=1)
    b1, b2, c = (f[:, 1:-1] ** 2).sum(axis=1), (f[:, :-2] ** 2).sum(axis=1), (f[:, 1:-1] * f[:, :-2]).sum(axis=1)
    det = b1 * b2 - c * c
    ok = (det > 1e-6 * np.maximum(b1 * b2, 1)) & (a0 > 0)
    det = np.where(ok, det, 1)
    w = np.stack([np.where(ok, (a1 * b2 - a2 * c) / det, 0), np.where(ok, (a2 * b1 - a1 * c) / det, 0)], axis=1)
    q = np.clip(np.rint(w * (1 << _SHIFT)), -(1 << (_PRECISION - 1)), (1 << (_PRECISION - 1)) - 1).astype(np.int32)
    guess = (q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> _SHIFT
    return q, np.concatenate([x[:, :2], x[:, 2:] - guess], axis=1)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """FLAC frames of rows of 576 signed samples; numbers: each frame's place in its stream."""
    x = samples.astype(np.int32)
    n = len(x)
    options = _predicted(x)
    q, lpc = _lpc(x)
    options.append(lpc)
    warm = [0, 1, 2, 3, 4, _LPC_ORDER]
    extra = [0, 0, 0, 0, 0, 9 + _LPC_ORDER * _PRECISION]
    bits, params = [], []
    for r, order, more in zip(options, warm, extra, strict=True):
        folded = _fold(r).reshape(n, PARTS, _PART)
        folded[:, 0, :order] = 0
        k, cost = _rice(folded.reshape(n * PARTS, _PART))
        k, cost = k.reshape(n, PARTS), cost.reshape(n, PARTS)
        bits.append(cost.sum(axis=1) - order * (1 + k[:, 0]) + 8 * order + 6 + 4 * PARTS + more)
        params.append(k)
    kind = np.stack(bits).argmin(axis=0)
    least = np.stack(bits).min(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    kind[least >= 8 * BLOCK] = 6
    kind[constant] = 7
    out: list[bytes] = [b""] * n
    for t in map(int, np.unique(kind)):
        mine = np.flatnonzero(kind == t)
        for i in range(0, len(mine), 2048):
            some = mine[i : i + 2048]
            body, sizes = _subframes(t, x[some], None if t > 5 else options[t][some], None if t > 5 else params[t][some], q[some])
            _close(out, some, body, sizes, numbers[some])
    return out


def _subframes(t: int, x: np.ndarray, r: np.ndarray | None, k: np.ndarray | None, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    full = lambda w: np.full(n, w, np.int64)
    bits = _Bits(n, BLOCK * 8 // 64 + 6)
    if t == 7:
        bits.put(np.zeros(n), full(8))
        bits.put(x[:, 0] & 255, full(8))
    elif t == 6:
        bits.put(np.full(n, 2), full(8))
        for i in range(BLOCK):
            bits.put(x[:, i] & 255, full(8))
    else:
        order = _LPC_ORDER if t == 5 else t
        bits.put(np.full(n, (32 + order - 1 if t == 5 else 8 + order) << 1), full(8))
        for i in range(order):
            bits.put(x[:, i] & 255, full(8))
        if t == 5:
            bits.put(np.full(n, (_PRECISION - 1) << 5 | _SHIFT), full(9))
            for i in range(order):
                bits.put(q[:, i] & ((1 << _PRECISION) - 1), full(_PRECISION))
        bits.put(np.full(n, PARTS.bit_length() - 1), full(6))  # method 0, partition order 2
        folded = _fold(r)
        high = folded >> k.repeat(_PART, axis=1).astype(np.uint32)
        for p in range(PARTS):
            kk = k[:, p]
            bits.put(kk, full(4))
            for i in range(max(order, p * _PART), (p + 1) * _PART):
                # zeros, a one, and the low bits in a single field unless the zeros are many
                h = high[:, i].astype(np.int64)
                if (far := int(h.max())) > 20:
                    for _ in range(0, far - 20, 20):
                        step = np.clip(h - 20, 0, 20)
                        bits.put(np.zeros(n), step)
                        h = h - step
                bits.put((np.uint32(1) << kk.astype(np.uint32)) | (folded[:, i] & ((np.uint32(1) << kk.astype(np.uint32)) - np.uint32(1))), h + 1 + kk)
    size = -(-bits.at // 8)
    return bits.words.astype(">u8").view(np.uint8).reshape(n, -1), size


def _close(out: list[bytes], some: np.ndarray, body: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> None:
    """Frame headers with CRC-8 in front and CRC-16 behind."""
    heads = [b"\xff\xf8" + bytes([0x25, 0x02]) + _utf8_number(int(k)) for k in numbers]  # 576 samples, 16 kHz (0b0101), mono, 8 bits
    wide = np.zeros((len(some), 12), np.uint8)
    for j, h in enumerate(heads):
        wide[j, : len(h)] = np.frombuffer(h, np.uint8)
    length = np.array([len(h) for h in heads])
    check = crc(wide, length, _CRC8)
    whole = np.zeros((len(some), 16 + int(sizes.max())), np.uint8)
    for j, h in enumerate(heads):
        whole[j, : len(h)] = wide[j, : len(h)]
        whole[j, len(h)] = check[j]
        whole[j, len(h) + 1 : len(h) + 1 + sizes[j]] = body[j, : sizes[j]]
    total = length + 1 + sizes
    tail = crc(whole, total, _CRC16)
    for j, k in enumerate(some):
        out[k] = whole[j, : total[j]].tobytes() + int(tail[j]).to_bytes(2, "big")


def padded(body: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return body + b"\xff" * (-len(body) % BLOCK if body else BLOCK)


def streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose size is a multiple of 576."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(128)).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    frames = encode_frames(samples, numbers)
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        mine = frames[at : at + c]
        sizes = list(map(len, mine))
        begins = np.cumsum([0, *sizes])
        points = b"".join(struct.pack(">QQH", k * BLOCK, int(begins[k]), BLOCK) for k in range(0, c, SEEK))
        packed = RATE << 44 | 0 << 41 | 7 << 36 | c * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples[at : at + c].tobytes(), usedforsecurity=False).digest()
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(mine))
        at += c
    return out


# ---- decoding


class Stream:
    """A stream's header: sample count, MD5, seek points, and where the first frame begins."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek, self.samples = 4, False, [], None
        while not last:
            last, kind, size = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            if kind == 0:
                low, high = struct.unpack_from(">HH", body)
                packed = int.from_bytes(body[10:18], "big")
                self.most, self.samples, self.md5 = int.from_bytes(body[7:10], "big"), packed & ((1 << 36) - 1), body[18:34]
                if (low, high) != (BLOCK, BLOCK) or (packed >> 36 & 31) != 7 or (packed >> 41 & 7):
                    raise ValueError("only mono 8-bit streams with blocks of 576 samples are read")
            elif kind == 3:
                self.seek = [struct.unpack_from(">QQH", body, k)[:2] for k in range(0, size, 18)]
            at += 4 + size
        if self.samples is None or self.samples % BLOCK:
            raise ValueError("no stream header, or a short last block")
        self.first = at


def _head_size(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of each frame header without its CRC."""
    b = raw[at + 4].astype(np.int64)
    lead = np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, np.where(b < 0xF8, 4, np.where(b < 0xFC, 5, np.where(b < 0xFE, 6, 7))))))
    return 4 + lead


class _Reader:
    """A bit position in each of many places of one byte array."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        wide = np.concatenate([raw, np.zeros(16, np.uint8)])
        # eight overlapping big-endian words: one gather reads 57 bits from any place
        self.words = np.lib.stride_tricks.as_strided(wide, (len(raw) + 8, 8), (1, 1))
        self.at = at.astype(np.int64) * 8

    def peek(self, on: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The next 57 bits of each place, at the top of 64."""
        at = self.at[on]
        word = np.ascontiguousarray(self.words[np.minimum(at >> 3, len(self.words) - 1)]).view(">u8").ravel().astype(np.uint64)
        return word << (at & 7).astype(np.uint64)

    def take(self, width: int) -> np.ndarray:
        out = (self.peek() >> np.uint64(64 - width)).astype(np.int64)
        self.at += width
        return out


def _zeros(bits: np.ndarray) -> np.ndarray:
    """Leading zeros among the top 32 bits, from a double's exponent; over 1000 if there is no one."""
    return 1054 - ((bits >> np.uint64(32)).astype(np.float64).view(np.int64) >> 52)


def _residuals(reader: _Reader, k: np.ndarray, count: int, out: np.ndarray) -> None:
    """Reads ``count`` Rice codes at each place into out's columns."""
    shift = np.minimum(np.uint64(64) - k.astype(np.uint64), np.uint64(63))
    plain = k == 0
    for i in range(count):
        bits = reader.peek()
        z = _zeros(bits)
        before = 0
        if (z > 31).any():
            before, slow = np.zeros(len(k), np.int64), np.flatnonzero(z > 31)
            while len(slow):
                reader.at[slow] += 32
                before[slow] += 32
                if (reader.at[slow] >> 3 >= len(reader.words)).any():
                    raise ValueError("a residual does not end")
                bits[slow] = reader.peek(slow)
                z[slow] = _zeros(bits[slow])
                slow = slow[z[slow] > 31]
        low = ((bits << (z + 1).astype(np.uint64)) >> shift).astype(np.int64)
        low[plain] = 0
        folded = (before + z) << k | low
        out[:, i] = (folded >> 1) ^ -(folded & 1)
        reader.at += z + 1 + k


def decode_frames(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, bytes) of the frames that begin at the given places; raises ValueError on a failed check."""
    if not len(at):
        return np.zeros((0, BLOCK), np.int8), np.zeros(0, np.int64)
    if not ((raw[at] == 0xFF) & (raw[at + 1] == 0xF8) & (raw[at + 2] >> 4 == 2) & (raw[at + 3] >> 1 == 1)).all():
        raise ValueError("a frame header is missing or not of the kind read here")
    head = _head_size(raw, at)
    wide = raw[np.minimum(at[:, None] + np.arange(12), len(raw) - 1)]
    if (crc(wide, head, _CRC8) != raw[at + head]).any():
        raise ValueError("a frame header's CRC-8 does not fit")
    n = len(at)
    x = np.zeros((n, BLOCK), np.int32)
    reader = _Reader(raw, at + head + 1)
    kind = reader.take(8) >> 1
    ends = reader.at.copy()
    for t in map(int, np.unique(kind)):
        mine = np.flatnonzero(kind == t)
        part = _Reader(raw, np.zeros(len(mine), np.int64))
        part.words, part.at = reader.words, reader.at[mine].copy()
        if t == 0:
            x[mine] = part.take(8).astype(np.uint8).view(np.int8)[:, None]
        elif t == 1:
            base = part.at >> 3
            x[mine] = raw[base[:, None] + np.arange(BLOCK)].view(np.int8)
            part.at += 8 * BLOCK
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            y = np.zeros((len(mine), BLOCK), np.int64)
            for i in range(order):
                y[:, i] = part.take(8).astype(np.uint8).view(np.int8)
            if t >= 32:
                spec = part.take(9)
                precision, shift = (spec >> 5) + 1, spec & 31
                weights = []
                for _ in range(order):
                    v = (part.peek() >> (64 - precision).astype(np.uint64)).astype(np.int64)
                    part.at += precision
                    weights.append(np.where(v >> (precision - 1), v - (np.int64(1) << precision), v))
            spec = part.take(6)
            if (spec >> 4).any() or (1 << spec.max(initial=0)) > BLOCK or (spec != spec[0]).any() or BLOCK % (1 << int(spec[0])):
                raise ValueError("a residual coding that is not read here")
            parts = 1 << int(spec[0])
            size = BLOCK // parts
            for p in range(parts):
                k = part.take(4)
                if (k > _MAX_RICE).any():
                    raise ValueError("an escaped Rice partition is not read here")
                a = max(order, p * size)
                _residuals(part, k, (p + 1) * size - a, y[:, a : (p + 1) * size])
            if t < 32:
                for step in range(order, 0, -1):  # each sum undoes one difference
                    y = _integrated(y, step, order)
            else:
                for i in range(order, BLOCK):
                    guess = sum(w * y[:, i - 1 - j] for j, w in enumerate(weights))
                    y[:, i] += guess >> shift
            x[mine] = y
        else:
            raise ValueError("a subframe kind that is not read here")
        ends[mine] = part.at
    size = -(-ends // 8) - at
    whole = raw[np.minimum(at[:, None] + np.arange(int(size.max())), len(raw) - 1)]
    end = at + size
    if (end + 2 > len(raw)).any() or (crc(whole, size, _CRC16) != (raw[end].astype(np.uint16) << np.uint16(8) | raw[end + 1])).any():
        raise ValueError("a frame's CRC-16 does not fit")
    if (np.abs(x) > 128).any():
        raise ValueError("a sample is out of range")
    return x.astype(np.int8), size + 2


def _integrated(y: np.ndarray, step: int, order: int) -> np.ndarray:
    """Residuals of order ``step`` to those of order ``step - 1``; the first ``order`` columns are samples."""
    out = y.copy()
    start = y[:, :order]
    for _ in range(step - 1):
        start = np.diff(start, axis=1)
    base = start[:, -1] if start.shape[1] else np.zeros(len(y), np.int64)
    out[:, order:] = np.cumsum(y[:, order:], axis=1) + base[:, None]
    return out


def frame_starts(raw: bytes, stream: Stream) -> np.ndarray:
    """Where the frames begin: a walk from seek point to seek point over header patterns, each proved by its checks later."""
    starts, at = [], stream.first
    n = stream.samples // BLOCK
    for k in range(n):
        if k:
            want = b"\xff\xf8" + bytes([0x25, 0x02]) + _utf8_number(k)
            check = 0
            for c in want:
                check = _CRC8_LIST[check ^ c]
            at = raw.find(want + bytes([check]), at + 9)
            if at < 0:
                raise ValueError("a frame is missing")
        starts.append(at)
    return np.array(starts, np.int64)


def payloads(media: list[bytes]) -> list[bytes]:
    """The payloads of many streams; every frame's checks, the sample counts and the MD5s are verified."""
    heads = [Stream(m) for m in media]
    base = np.cumsum([0, *map(len, media)])
    starts = [frame_starts(m, h) + b for m, h, b in zip(media, heads, base[:-1], strict=True)]
    raw = np.frombuffer(b"".join(media), np.uint8)
    every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    samples, sizes = decode_frames(raw, every)
    out, at = [], 0
    for h, s, end in zip(heads, starts, base[1:], strict=True):
        mine = samples[at : at + len(s)]
        if len(s) and ((s[1:] != s[:-1] + sizes[at : at + len(s) - 1]).any() or s[-1] + sizes[at + len(s) - 1] != end):
            raise ValueError("frames do not follow each other")
        if hashlib.md5(mine.tobytes(), usedforsecurity=False).digest() != h.md5:
            raise ValueError("the samples' MD5 does not fit")
        out.append((mine.view(np.uint8) ^ np.uint8(128)).tobytes())
        at += len(s)
    return out


def from_sample(media: bytes, sample: int, count: int) -> bytes:
    """Samples [sample, sample + count) as payload bytes, from the nearest seek point on."""
    head = Stream(media)
    first, offset = max((p for p in head.seek if p[0] <= sample), default=(0, 0))
    count = max(0, min(count, head.samples - sample))
    raw, out, at, k = np.frombuffer(media, np.uint8), [], head.first + offset, first // BLOCK
    while count and k * BLOCK < sample + count:
        got, size = decode_frames(raw, np.array([at]))
        out.append(got)
        at, k = at + int(size[0]), k + 1
    done = b"".join((x.view(np.uint8) ^ np.uint8(128)).tobytes() for x in out)
    return done[sample - first : sample - first + count]


# ---- Spark


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, offs in text_chunks(batches, 2 << 20):
        texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        media = streams([padded(t) for t in texts])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offs)), binary_rows([np.frombuffer(m, np.uint8) for m in media])], ["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded with 255 to a multiple of 576, as a FLAC stream."""
    return id_text(docs).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _media_chunks(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    held, first, size = [], 0, 0
    for k, m in enumerate(batch.column(column)):
        held.append(m.as_py())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, first, size = [], k + 1, 0
    if held:
        yield first, held


def features(payload: bytes) -> str:
    """Level figures of the samples as JSON: mean, power, zero crossings, peak."""
    x = (np.frombuffer(payload, np.uint8) ^ np.uint8(128)).view(np.int8).astype(np.int64)
    return json.dumps({"samples": len(x), "sum": int(x.sum()), "power": int((x * x).sum()), "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum()), "peak": int(np.abs(x).max())})


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for at, media in _media_chunks(batch, 2):
            got = payloads(media)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(got)), batch.column(1).slice(at, len(got)), pa.array([len(p) for p in got], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in got]),
                 pa.array([zlib.crc32(p[-32:]) for p in got], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([features(p) for p in got])],
                names,
            )


def decode(media: DataFrame) -> DataFrame:
    """Reads the streams of (doc_id, n_bytes, media) back: sizes and digests of payload and media, and features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _blocks(per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, media in _media_chunks(batch, 1):
                rows = [(i, s, p[s : s + per_block]) for i, p in zip(batch.column(0).slice(at, len(media)).to_pylist(), payloads(media), strict=True) for s in range(0, len(p), per_block)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "sample", "pcm"])

    return run


def pcm_blocks(media: DataFrame, frames: int = SEEK) -> DataFrame:
    """(doc_id, sample, pcm): decoded blocks of ``frames`` frames with the place of their first sample."""
    return media.select("doc_id", "media").mapInArrow(_blocks(frames * BLOCK), "doc_id long, sample long, pcm binary")


def seek(media: DataFrame, sample: int, count: int) -> DataFrame:
    """(doc_id, pcm): ``count`` samples from ``sample`` on; only the frames from the seek point on are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([from_sample(m.as_py(), sample, count) for m in batch.column(1)], pa.binary())], ["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")
