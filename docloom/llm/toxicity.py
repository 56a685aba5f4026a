"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word's own hashed vector and the mean of the hashed vectors of its character n-grams (its first
3 to 6 bytes, its last 3, and the whole word), so unseen words with a known beginning are recognised. A window has 24
words; windows begin every 12 words and one ends with the text, so all words are covered and neighbours overlap. Each
window gives a logit; a document's score is the calibrated logistic of its largest, and 0 without words.

Training uses at most ``most_positive`` + ``most_negative`` labelled documents (1,500 and 3,000, in hash order of
doc_id, held-out rows excluded) of at most 1 MiB each and ``most_bytes`` (32 MiB) in all, in one task; labels mark whole documents: n-gram log-odds first pick the windows that
stand for a document, then the network is trained on them, then clean documents' highest windows are added and
training goes on, and last the document scores are calibrated on the same documents. The seed is fixed.

Nulls and empty texts: score 0. A doc_id with several labels counts as toxic if one says so. Without any toxic or any
clean label every score is 0. Rows that repeat a doc_id each give a row. labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, fitted, id_text, prefix_hash, range_hash, spaced, text_chunks, unused

WINDOW, STRIDE, HIDDEN, DIM, ATTENTION = 24, 12, 8, 8, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 17
THRESHOLD = 0.3
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word number of each word, first word of each text + the count, slots of each distinct word: its own, then six n-grams')."""
    text, begins = spaced(ascii_lower(data), offs)
    upper = np.append(False, text[:-1] == 0xC3) & (text >= 0x80) & (text < 0x9F) & (text != 0x97)
    text = np.where(upper, text | np.uint8(0x20), text)  # the capitals of Latin-1
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = _WORD[text]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = prefix_hash(text)
    whole = range_hash(h, start, end)
    word, at, number = np.unique(whole, return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    grams = [word] + [range_hash(h, start, np.minimum(start + k, end)) ^ np.uint64(k) for k in (3, 4, 5, 6)] + [range_hash(h, np.maximum(end - 3, start), end) ^ np.uint64(9)]
    slots = [(word % np.uint64(WORD_SLOTS))] + [g % np.uint64(GRAM_SLOTS) for g in grams]
    return number.ravel(), np.searchsorted(np.flatnonzero(edge == 1), begins), np.stack(slots, axis=1).astype(np.int64)


def tokens_of_many(texts: list[bytes], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of a list, some texts at a time; a word may get several numbers."""
    parts, some, size = [], [], 0
    for k, t in enumerate(texts):
        some.append(t)
        size += len(t)
        if size >= most or k == len(texts) - 1:
            n, f, s = tokens(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
            parts.append((n.astype(np.int32), f, s.astype(np.int32)))
            some, size = [], 0
    base = np.cumsum([0, *(len(s) for _, _, s in parts)])
    shift = np.cumsum([0, *(len(n) for n, _, _ in parts)])
    first = np.concatenate([[0], *(f[1:] + a for (_, f, _), a in zip(parts, shift, strict=False))])
    return np.concatenate([n + np.int32(b) for (n, _, _), b in zip(parts, base, strict=False)]), first, np.concatenate([s for _, _, s in parts])


def document_counts(first: np.ndarray, number: np.ndarray, slots: np.ndarray, flag: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """In how many flagged and other documents each n-gram slot occurs, some documents at a time."""
    out = [np.zeros(GRAM_SLOTS, np.int64), np.zeros(GRAM_SLOTS, np.int64)]
    at = 0
    while at < len(flag):
        to = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
        doc = np.repeat(np.arange(to - at), np.diff(first[at : to + 1]))
        pair = np.unique(doc * np.int64(len(slots)) + number[first[at] : first[to]])
        of, word = pair // max(1, len(slots)), pair % max(1, len(slots))
        mine = flag[at:to]
        for k in range(1, slots.shape[1]):
            once = np.unique(of * GRAM_SLOTS + slots[word, k])
            for side, some in zip(out, (mine[once // GRAM_SLOTS], ~mine[once // GRAM_SLOTS]), strict=True):
                side += np.bincount(once[some] % GRAM_SLOTS, minlength=GRAM_SLOTS)
        at = to
    return out[0], out[1]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, first word) of all windows: one every STRIDE words and one that ends with the text."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Vectors, two gated recurrent units, attention, and the calibrated output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        part = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.word, self.gram = part(WORD_SLOTS, DIM) * 3, part(GRAM_SLOTS, DIM) * 3
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", part(2 * DIM, 3 * HIDDEN)), ("U", part(HIDDEN, 3 * HIDDEN)), ("b", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"A": part(2 * HIDDEN, ATTENTION), "v": part(ATTENTION), "o": part(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale, self.shift, self.trained = 1.0, 0.0, False

    def vectors(self, slots: np.ndarray) -> np.ndarray:
        return np.concatenate([self.word[slots[:, 0]], self.gram[slots[:, 1:]].mean(axis=1)], axis=1)

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        """Step inputs of each distinct word in both directions; the last row is for no word."""
        return [np.concatenate([x @ self.p["W" + d] + self.p["b" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]

    def run(self, steps: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ids into steps), and with ``keep`` all that the gradient needs."""
        n, t = ids.shape
        states, saved = np.zeros((t, n, 2 * HIDDEN), np.float32), []
        for d, name in enumerate("fb"):
            u, h = self.p["U" + name], np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                x, g = steps[d][ids[:, i]], h @ u
                gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                m = mask[:, i : i + 1]
                after = h + m * (1 - z) * (new - h)
                if keep:
                    saved.append((h, z, r, new, g[:, 2 * HIDDEN :]))
                h = after
                states[i, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        a = np.tanh(states @ self.p["A"])
        e = a @ self.p["v"] + (mask.T - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = (states * w[:, :, None]).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (states, saved, a, w, pooled)) if keep else logit

    def gradient(self, steps, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """(loss, gradients of p, gradients of the step inputs in both directions) of weighted log loss."""
        logit, (states, saved, a, w, pooled) = self.run(steps, ids, mask, keep=True)
        q, p, g = _sigmoid(logit), self.p, {}
        loss = float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).mean())
        dl = (weight * (q - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        dw = (states * dpool).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tni,tnj->ij", states, da)
        ds = w[:, :, None] * dpool + da @ p["A"].T
        t, out, k = ids.shape[1], [], len(saved)
        for d, name in reversed(list(enumerate("fb"))):
            dh, dx, u = np.zeros((len(ids), HIDDEN), np.float32), np.zeros((t, len(ids), 3 * HIDDEN), np.float32), p["U" + name]
            g["U" + name] = np.zeros_like(u)
            for i in range(t - 1, -1, -1) if d == 0 else range(t):
                k -= 1
                h, z, r, new, gn = saved[k]
                m = mask[:, i : i + 1]
                dh = dh + ds[i, :, d * HIDDEN : (d + 1) * HIDDEN]
                dnew = dh * m * (1 - z) * (1 - new * new)
                dz = dh * m * (h - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                dgates = np.concatenate([dz, dr, dnew * r], axis=1)
                g["U" + name] += h.T @ dgates
                dx[i] = np.concatenate([dz, dr, dnew], axis=1)
                dh = dh * (1 - m * (1 - z)) + dgates @ u.T
            out.append(dx)
        return loss, g, out[::-1]

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def _ids(number: np.ndarray, first: np.ndarray, text: np.ndarray, start: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = at < first[text + 1][:, None]
    return np.where(mask, number[np.minimum(at, len(number) - 1)], none), mask.astype(np.float32)


def window_logits(net: Network, number: np.ndarray, first: np.ndarray, slots: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, logit) of all windows."""
    text, start = windows(first)
    steps = net.projected(net.vectors(slots))
    out = np.zeros(len(text), np.float32)
    for i in range(0, len(text), block):
        ids, mask = _ids(number, first, text[i : i + block], start[i : i + block], len(slots))
        out[i : i + block] = net.run(steps, ids, mask)
    return text, start, out


def all_logits(net: Network, number: np.ndarray, first: np.ndarray, slots: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """``window_logits`` of many texts, some at a time, each with the words it uses."""
    out, at, n = [np.zeros(0, np.float32)], 0, len(first) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
        used, local = np.unique(number[first[at] : first[to]], return_inverse=True)
        out.append(window_logits(net, local.ravel(), first[at : to + 1] - first[at], slots[used])[2])
        at = to
    return np.concatenate(out)


def best_by_text(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each text, -inf without one."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, text, value)
    return out


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7, rounds: int = 2, batch: int = 256) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    y = toxic.astype(bool)
    if not y.any() or y.all():
        return net
    number, first, slots = tokens_of_many(texts)
    # log-odds of the n-grams over documents, and of each word as its strongest n-gram's
    up, down = document_counts(first, number, slots, y)
    odds = np.log((up + 0.2) / (y.sum() + 1)) - np.log((down + 0.2) / ((~y).sum() + 1))
    odds = np.where(up + down >= 3, odds, np.minimum(odds, 0.5)) * np.sqrt((up + down) / (up + down + 2.0))
    net.gram[:, 0] = odds / 2
    strong = odds[slots[:, 1:]].max(axis=1).astype(np.float32)[number]
    text, start = windows(first)
    hint = np.full(len(text), -9.0)
    for k in range(WINDOW):
        at = start + k
        hint = np.where(at < first[text + 1], np.maximum(hint, strong[np.minimum(at, len(strong) - 1)]), hint)
    adam, rate = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0.01
    square, n_steps = [np.full(len(net.word), 1e-6), np.full(len(net.gram), 1e-6)], 0
    value = hint
    chosen = np.zeros(0, np.int64)
    for turn in range(rounds):
        # each document's best window stands for it; clean ones add another at random
        order = np.lexsort((-value, text))
        top = order[np.append(True, text[order][1:] != text[order][:-1])] if len(order) else order
        extra = rng.choice(len(text), min(len(text), len(top)), replace=False)
        chosen = np.unique(np.concatenate([chosen[~y[text[chosen]]], top, extra[~y[text[extra]]]]))
        label = y[text[chosen]].astype(np.float32)
        weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
        for _ in range(max(3, min(40, 400 // max(1, len(chosen) // batch)) if turn == 0 else 2)):
            mixed = rng.permutation(len(chosen))
            for i in range(0, len(mixed), batch):
                some = mixed[i : i + batch]
                w = chosen[some]
                ids, mask = _ids(number, first, text[w], start[w], len(slots))
                used, local = np.unique(ids, return_inverse=True)
                local = local.reshape(len(w), WINDOW)
                real = used[used < len(slots)]
                x = net.vectors(slots[real])
                steps = net.projected(x)
                _, g, dx = net.gradient(steps, local, mask, label[some], weight[some])
                dv = np.zeros_like(x)
                for d, name in enumerate("fb"):
                    total = np.zeros((len(real) + 1, 3 * HIDDEN), np.float32)
                    np.add.at(total, local.T, dx[d])
                    total = total[: len(real)]
                    g["W" + name], g["b" + name] = x.T @ total, total.sum(axis=0)
                    dv += total @ net.p["W" + name].T
                n_steps += 1
                for k, v in net.p.items():
                    m1, m2 = adam[k]
                    m1 += 0.1 * (g[k] - m1)
                    m2 += 0.001 * (g[k] ** 2 - m2)
                    v -= rate * (m1 / (1 - 0.9**n_steps)) / (np.sqrt(m2 / (1 - 0.999**n_steps)) + 1e-8)
                grams = slots[real, 1:]
                for vectors, sq, rows, dd in ((net.word, square[0], slots[real, 0], dv[:, :DIM]), (net.gram, square[1], grams.ravel(), np.repeat(dv[:, DIM:] / grams.shape[1], grams.shape[1], axis=0))):
                    np.add.at(sq, rows, (dd**2).mean(axis=1))
                    np.add.at(vectors, rows, (-0.05 * dd / np.sqrt(sq[rows])[:, None]).astype(np.float32))
        value = all_logits(net, number, first, slots)
    best = best_by_text(text, value, len(texts))
    seen = np.isfinite(best)
    # a logistic fit of the documents' scores; the target is a little short of 0 and 1
    z, t = best[seen], np.where(y[seen], 1 - 1 / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        q = _sigmoid(a * z + b)
        s = q * (1 - q) + 1e-6
        grad = np.array([((q - t) * z).sum() + 1e-3 * (a - 1), (q - t).sum()])
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    net.scale, net.shift, net.trained = max(float(a), 1e-3), float(b), True
    return net


# ---- Spark


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 4 == 2


def _network(texts: list[bytes], label: np.ndarray) -> Network:
    return train(texts, label > 0)


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 1_500, most_negative: int = 3_000, most_bytes: int = 32 << 20) -> Network:
    """The network, trained in one task on a bounded sample of the labelled documents that are not held out."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label")).where(~held_out())
    some = lambda kind, n: marks.where(f"label {kind} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = some(">", most_positive).unionByName(some("<=", most_negative))
    # at most the sum of both bounds in rows, so this side may be broadcast
    return fitted(id_text(docs).join(F.broadcast(sample), "doc_id"), _network, most_bytes)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for ids, data, offs in text_chunks(batches):
            number, first, slots = tokens(data, offs)
            text, _, logit = window_logits(net, number, first, slots) if net.trained else (np.zeros(0, np.int64), None, np.zeros(0))
            best = best_by_text(text, logit, len(ids))
            p = np.where(np.isfinite(best), net.probability(best), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(np.bincount(text, minlength=len(ids)).astype(np.int64))], ["doc_id", "score", "predicted", "n_windows"])

    out = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_windows long")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_windows")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the network does not reject. Rows without a doc_id go."""
    name = unused(docs, "bad_id")
    bad = toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.where("doc_id is not null").join(bad, F.col("doc_id") == F.col(name), "left_anti")
