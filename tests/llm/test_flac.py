import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import flac


def plain_bits(raw):
    return "".join(f"{b:08b}" for b in raw)


def plain_decode(frame):
    """One frame, bit by bit."""
    head = 5 if frame[4] < 128 else 6 if frame[4] < 0xE0 else 7
    bits, at = plain_bits(frame[head + 1 : -2]), 0

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    kind = take(8) >> 1
    if kind == 0:
        return [signed(8)] * 576
    if kind == 1:
        return [signed(8) for _ in range(576)]
    order = kind - 31 if kind >= 32 else kind - 8
    x = [signed(8) for _ in range(order)]
    if kind >= 32:
        p, shift = take(4) + 1, take(5)
        w = [signed(p) for _ in range(order)]
    else:
        shift, w = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
    assert take(2) == 0
    parts = 1 << take(4)
    for part in range(parts):
        k = take(4)
        while len(x) < (part + 1) * 576 // parts:
            q = 0
            while not take(1):
                q += 1
            v = q << k | take(k)
            x.append((v >> 1 ^ -(v & 1)) + (sum(a * b for a, b in zip(w, reversed(x), strict=False)) >> shift))
    return x


def kinds():
    rng = np.random.default_rng(4)
    t = np.arange(576)
    yield b"\x07" * 576
    yield rng.integers(0, 256, 576, np.uint8).tobytes()
    yield (128 + 100 * np.sin(t / 20)).astype(np.uint8).tobytes()
    yield (t % 200).astype(np.uint8).tobytes()
    yield (b"the quick brown fox " * 40)[:576]
    yield (np.where(t == 300, 255, 0)).astype(np.uint8).tobytes()
    yield (128 + 90 * np.sin(t / 3) + rng.normal(0, 1, 576)).astype(np.uint8).tobytes()


@pytest.mark.parametrize("payload", list(kinds()))
def test_frames_by_a_plain_decoder(payload):
    (stream,) = flac.streams([payload * 3])
    head = flac.Stream(stream)
    starts = [*flac.frame_starts(stream, head), len(stream)]
    for a, b in zip(starts, starts[1:], strict=False):
        assert bytes((v + 128) & 255 for v in plain_decode(stream[a:b])) == payload
    assert flac.payloads([stream]) == [payload * 3]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=1500), st.text(max_size=900).map(str.encode)), min_size=1, max_size=5))
def test_round_trip(bodies):
    padded = [flac.padded(b) for b in bodies]
    assert flac.payloads(flac.streams(padded)) == padded


def test_long_stream_and_seeking():
    rng = random.Random(2)
    body = flac.padded("".join(rng.choice("etaoin shrdlu\n") for _ in range(200_000)).encode())
    (stream,) = flac.streams([body])
    assert flac.payloads([stream]) == [body] and len(flac.Stream(stream).seek) > 5
    for at in (0, 1, 575, 576, 100_001, len(body) - 3):
        assert flac.from_sample(stream, at, 700) == body[at : at + 700]


def test_damage_is_found():
    (stream,) = flac.streams([flac.padded(b"some text of a document " * 60)])
    first = flac.Stream(stream).first
    missed = 0
    for at in range(first, len(stream), 7):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.payloads([bytes(bad)])
            missed += 1
    with pytest.raises(ValueError):
        flac.payloads([stream[:-5]])
    with pytest.raises(ValueError):
        flac.Stream(b"RIFF....")
    assert not missed


def test_query_rows(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "x" * 576), (5, "long é " * 9000), (6, "short"), (6, "short"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, media string")
    media = flac.encode(df)
    got = {r.doc_id: r for r in flac.decode(media).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and flac.decode(media).count() == 7
    for i, t in rows[:-1]:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[1].media_sha256 == got[6].media_sha256 != got[4].media_sha256
    blocks = flac.pcm_blocks(media.where("doc_id = 5"), frames=10).orderBy("sample").collect()
    assert b"".join(b.pcm for b in blocks) == flac.padded(("long é " * 9000).encode()) and blocks[1].sample == 5760
    assert flac.seek(media.where("doc_id = 5"), 3000, 10).first().pcm == ("long é " * 9000).encode()[3000:3010]
    assert flac.decode(flac.encode(df.limit(0))).count() == 0
