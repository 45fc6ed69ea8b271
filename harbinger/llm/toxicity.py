"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters and digits with a letter in it, in lower case) enters the network as word and character inputs, from hashed slots: an embedding of the word and the mean embedding
of its runs of 4 and 5 bytes, both learned with the network, and beside them counted log-odds of the word and the
largest, mean and least of its runs, which hold what is too rare to be learned. Two GRUs read windows of WINDOW words, one in each direction; attention weighs their
states; a logistic unit gives the window's score. Windows overlap by half, all of them are scored, and a
document's score is that of its worst window.

Training sees at most SAMPLE documents of each label, those of least hash, so its cost and memory are bounded;
scoring covers every window of every whole text and needs no shuffle. A document's label holds for its worst
window only (multiple-instance learning): each epoch trains on the window that scores highest now, which for
clean documents is the hardest one, of CANDIDATES windows with the hottest words of each document. Then the bias is
lowered where more than CLEAN_FLAGGED of the sample's clean documents would reach THRESHOLD, read either through
tables that did not count them or through those that score, as happens with few labels.

Texts without letters, null ones too, score 0. Without labelled documents of both kinds every score is 0.
Label rows with nulls or of unknown documents are ignored; a document labelled several times counts as toxic
if any label says so. Of several texts of one id the least is learned from. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm import bytescan, common

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
#: Inputs of a word: counted ones, and the learned embeddings of the word and of its runs.
COUNTED, EMBED = 8, 4
INPUTS = COUNTED + 2 * EMBED
EMBED_BITS, DECAY = 14, 0.01
#: Labelled documents of each label that training reads at most, and windows of each that it may choose from.
SAMPLE, CANDIDATES = 2500, 6
WORD_BITS, GRAM_BITS = 17, 18
#: Epochs are as many as give LEAST_STEPS steps on few documents.
EPOCHS, BATCH, RATE, LEAST_STEPS = 14, 256, 0.01, 250
THRESHOLD = 0.7
#: Share of the clean documents of the sample that may reach the threshold; the network's bias is lowered until it holds.
CLEAN_FLAGGED = 0.01
CHUNK = 4096
#: Bytes of a pass, and words at once, of what the driver does.
TRAIN_BYTES, TRAIN_WORDS = 1 << 18, 1 << 14


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case (ASCII and Latin-1 letters) and the words in them: bytes, start, end, text number."""
    low = bytescan.lowered(data)
    if low.size > 1:
        after = np.flatnonzero(low[:-1] == 0xC3) + 1
        capital = after[(low[after] >= 0x80) & (low[after] <= 0x9E) & (low[after] != 0x97)]
        low[capital] += 0x20
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    start, end, doc = bytescan.words(np.where(letter | ((low >= 48) & (low <= 57)), low, np.uint8(32)), offsets)
    sums = np.concatenate([[0], np.cumsum(letter)])
    some = sums[end] > sums[start]
    return low, start[some], end[some], doc[some]


def distinct(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each word's number, and a place where each distinct one stands."""
    h = bytescan.hashes(low, start, end)
    once, first, back = np.unique(h, return_index=True, return_inverse=True)
    return once, back, start[first], end[first]


def grams(low: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of `size` bytes of each word (a shorter word is one run): slots, and the word each belongs to."""
    n = np.maximum(1, end - start - size + 1)
    word = np.repeat(np.arange(start.size), n)
    at = np.arange(word.size) - np.repeat(np.cumsum(n) - n, n) + start[word]
    h = np.full(at.size, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            place = at + k
            byte = np.where(place < end[word], low[np.minimum(place, low.size - 1)], 0).astype(np.uint64)
            h = h * np.uint64(0x100000001B3) + byte + np.uint64(1)
        return (bytescan.mix(h) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), word


@dataclass
class Model:
    """Log-odds tables and the network's weights; all sizes are fixed."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray]

    def inputs(self, low: np.ndarray, once: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Word and character inputs of distinct words."""
        x = self.counted(low, once, start, end)
        return np.concatenate([x, embedded(self.p, *slots(low, once, start, end))], axis=1)

    def counted(self, low: np.ndarray, once: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = np.zeros((once.size, COUNTED), np.float32)
        x[:, 0] = self.words[(once >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
        for k, size in enumerate((4, 5)):
            slot, word = grams(low, start, end, size)
            odds = self.grams[slot]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if word.size else np.empty(0, np.int64)
            if first.size:
                x[:, 1 + 3 * k] = np.maximum.reduceat(odds, first)
                x[:, 2 + 3 * k] = np.add.reduceat(odds, first) / np.diff(np.append(first, odds.size))
                x[:, 3 + 3 * k] = np.minimum.reduceat(odds, first)
        x[:, 7] = 0.1 * np.minimum(end - start, 20)
        return x


def slots(low: np.ndarray, once: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: the embedding slot of each, and the slots of its runs of bytes, word by word, with their number."""
    parts = [grams(low, start, end, size) for size in (4, 5)]
    slot, word = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(word, kind="stable")
    return (once >> np.uint64(64 - EMBED_BITS)).astype(np.uint16), (slot[order] >> (GRAM_BITS - EMBED_BITS)).astype(np.uint16), np.bincount(word, minlength=once.size)


def picked(at: np.ndarray, word: np.ndarray, run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of some words."""
    m = n[at]
    return word[at], run[np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())], m


def embedded(p: dict, word: np.ndarray, run: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The learned inputs of words with such slots."""
    if not word.size:
        return np.zeros((0, 2 * EMBED), np.float32)
    return np.concatenate([p["ew"][word], np.add.reduceat(p["eg"][run], np.cumsum(n) - n) / n[:, None].astype(np.float32)], axis=1)


def scattered(d: np.ndarray, word: np.ndarray, run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the embedding tables from those of the learned inputs of words."""
    of = lambda at, x: np.stack([np.bincount(at, x[:, k], 1 << EMBED_BITS) for k in range(EMBED)], axis=1).astype(np.float32)
    return of(word, d[:, :EMBED]), of(run, np.repeat(d[:, EMBED:] / n[:, None], n, axis=0))


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words: text number, first word within all words, and length of each window."""
    n = np.where(count > 0, np.maximum(1, -(-(count - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(count.size), n)
    k = np.arange(text.size) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(count) - count)[text] + STRIDE * k
    return text, first, np.minimum(WINDOW, count[text] - STRIDE * k)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(x: np.ndarray, live: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, HIDDEN) of projected inputs (time, window, 3 HIDDEN); live: (time, window) or None."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    out, saved = np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = h @ u
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        gn = g[:, 2 * HIDDEN :]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * gn)
        new = c + z * (h - c)
        if live is not None:
            new = np.where(live[t][:, None], new, h)
        if keep:
            saved.append((t, h, z, r, c, gn))
        h = out[t] = new
    return out, saved


def forward(p: dict, x: list[np.ndarray], live: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows from projected inputs of both directions."""
    (hf, sf), (hb, sb) = _gru(x[0], live, p["uf"], False, keep), _gru(x[1], live, p["ub"], True, keep)
    h = np.concatenate([hf, hb], axis=2)
    a = np.tanh(h @ p["wa"])
    e = a @ p["va"]
    if live is not None:
        e = np.where(live, e, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", e, h)
    return pooled @ p["wo"] + p["bo"][0], {"h": h, "a": a, "e": e, "pooled": pooled, "sf": sf, "sb": sb} if keep else {}


def project(p: dict, x: np.ndarray) -> list[np.ndarray]:
    return [x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]]


def gradients(p: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss, by parameter and, as x, by input (time, window, INPUTS)."""
    logit, s = forward(p, project(p, x), live, keep=True)
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("ew", "eg")} | {"x": np.zeros_like(x)}
    d = (_sigmoid(logit) - y) * weight / y.size
    g["wo"], g["bo"][0] = s["pooled"].T @ d, d.sum()
    dp = np.outer(d, p["wo"])
    dh = s["e"][:, :, None] * dp[None]
    de = np.einsum("tnh,nh->tn", s["h"], dp)
    de = s["e"] * (de - (s["e"] * de).sum(axis=0))
    g["va"] = np.einsum("tna,tn->a", s["a"], de)
    da = de[:, :, None] * p["va"] * (1 - s["a"] ** 2)
    g["wa"] = np.einsum("tnh,tna->ha", s["h"], da)
    dh += da @ p["wa"].T
    for way, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
        u, w = p[f"u{way}"], p[f"w{way}"]
        carry = np.zeros_like(part[0])
        for t, h, z, r, c, gn in reversed(s[f"s{way}"]):
            whole = part[t] + carry
            on = live[t][:, None]
            own = np.where(on, whole, 0)
            dc = own * (1 - z) * (1 - c**2)
            dz = own * (h - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"w{way}"] += x[t].T @ dx
            g["x"][t] += dx @ w.T
            g[f"b{way}"] += dx.sum(axis=0)
            g[f"u{way}"] += h.T @ dg
            carry = np.where(on, own * z, whole) + dg @ u.T
    return g


def _tables(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of hashed words and character runs, by the documents of each label that hold them."""
    counts = [np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << GRAM_BITS))]
    data, offsets = bytescan.raw(texts)
    for lo, hi in bytescan.passes(offsets, TRAIN_BYTES):
        low, start, end, doc = letters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not start.size:
            continue
        once, back, s, e = distinct(low, start, end)
        held = np.unique(doc * once.size + back)
        d, w = held // once.size, held % once.size
        slots = [(once >> np.uint64(64 - WORD_BITS)).astype(np.int64)[w]]
        owners = [d]
        parts = [grams(low, s, e, size) for size in (4, 5)]
        slot, word = np.concatenate([q[0] for q in parts]), np.concatenate([q[1] for q in parts])
        order = np.argsort(word, kind="stable")
        slot, n = slot[order], np.bincount(word, minlength=once.size)
        first = np.cumsum(n) - n
        k = np.repeat(first[w], n[w]) + np.arange(n[w].sum()) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
        slots.append(slot[k])
        owners.append(np.repeat(d, n[w]))
        for table, at, own in zip(counts, slots, owners, strict=True):
            pair = np.unique(own << 20 | at)
            own, at = pair >> 20, pair & (1 << 20) - 1
            for label in (0, 1):
                mine = y[lo:hi][own] == label
                table[label] += np.bincount(at[mine], minlength=table.shape[1])
    total = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    return tuple((np.log((t[1] + 1) / (total[1] + 2)) - np.log((t[0] + 1) / (total[0] + 2))).astype(np.float32) * (1 - 1 / (1 + 0.2 * t.sum(axis=0))).astype(np.float32) for t in counts)


def train(texts: pa.Array, y: np.ndarray, seed: int = 11) -> Model | None:
    """The network, from texts and labels; None without both labels."""
    y = np.asarray(y, np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    rng = np.random.default_rng(seed)
    size = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"wa": size(2 * HIDDEN, ATTENTION), "va": size(ATTENTION), "wo": size(2 * HIDDEN), "bo": np.full(1, -2, np.float32)}
    for way in "fb":
        p |= {f"w{way}": 0.5 * size(INPUTS, 3 * HIDDEN), f"u{way}": 0.5 * size(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {e: np.zeros((1 << EMBED_BITS, EMBED), np.float32) for e in ("ew", "eg")}  # slots that training does not meet say nothing
    model = Model(*_tables(texts, y), p)
    # Training reads tables of the other half: a document's own words must not give its label away.
    half = np.zeros(y.size, np.int64)
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        half[mine[rng.permutation(mine.size)[: mine.size // 2]]] = 1
    crossed = [Model(*_tables(texts.filter(pa.array(half != k)), y[half != k]), p) for k in (0, 1)]
    held, owner, sizes, number, known, words = [], [], [], [], [], 0
    data, offsets = bytescan.raw(texts)
    for lo, hi in bytescan.passes(offsets, TRAIN_BYTES):
        low, start, end, doc = letters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not start.size:
            continue
        once, back, s, e = distinct(low, start, end)
        x = np.concatenate([c.counted(low, once, s, e) for c in crossed])
        plain, back = back, back + once.size * half[lo:hi][doc]
        text, first, length = windows(np.bincount(doc, minlength=hi - lo))
        top = np.append(np.maximum(x[:, 0], x[:, 1])[back], np.full(WINDOW, -99, np.float32))
        heat = np.max(top[first[:, None] + np.arange(WINDOW)] + np.where(np.arange(WINDOW) < length[:, None], 0, -99), axis=1)
        order = np.lexsort((-heat, text))
        rank = np.arange(order.size) - np.searchsorted(text[order], text[order], "left")
        order = order[rank < CANDIDATES]
        at = np.minimum(first[order][:, None] + np.arange(WINDOW), back.size - 1)
        held.append(x[back[at]])
        met, here = np.unique(plain[at], return_inverse=True)
        known.append((once[met], *slots(low, once[met], s[met], e[met])))
        number.append(here.reshape(at.shape) + words)
        words += met.size
        owner.append(text[order] + lo)
        sizes.append(length[order])
    if not held:
        return None
    x, owner, sizes, number = np.concatenate(held), np.concatenate(owner), np.concatenate(sizes), np.concatenate(number)
    once, word, run, n_runs = (np.concatenate(c) for c in zip(*known, strict=True))
    _, kept, same = np.unique(once, return_index=True, return_inverse=True)
    number, (word, run, n_runs) = np.ascontiguousarray(same.astype(np.int32)[number].T), picked(kept, word, run, n_runs)
    spread = x[np.arange(WINDOW)[None, :] < sizes[:, None]].std(axis=0) + 1e-3
    x = np.ascontiguousarray(x.transpose(1, 0, 2))
    live = np.arange(WINDOW)[:, None] < sizes[None, :]
    for way in "fb":
        p[f"w{way}"][:COUNTED] /= np.maximum(1, spread)[:, None].astype(np.float32)
    docs, first = np.unique(owner, return_index=True)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    label = y[docs].astype(np.float32)
    batches = max(1, docs.size // min(BATCH, max(16, docs.size // 16)))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))

    def whole(own: slice | np.ndarray, learned: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:, own], learned[number[:, own]]], axis=2)

    for epoch in range(epochs):
        learned = np.concatenate([embedded(p, *picked(np.arange(k, min(k + TRAIN_WORDS, word.size)), word, run, n_runs)) for k in range(0, word.size, TRAIN_WORDS)])
        score = np.concatenate([forward(p, project(p, whole(slice(k, k + CHUNK), learned)), live[:, k : k + CHUNK])[0] for k in range(0, owner.size, CHUNK)])
        if epoch == 0:
            score = -np.arange(owner.size, dtype=np.float32)  # the hottest by its inputs
        best = np.maximum.reduceat(score, first)
        chosen = np.array([np.flatnonzero(score[i:j] == b)[0] + i for i, j, b in zip(first, [*first[1:], owner.size], best, strict=True)])
        for k in np.array_split(rng.permutation(chosen.size), min(batches, chosen.size)):
            own = chosen[k]
            met, at = np.unique(number[:, own], return_inverse=True)
            at = at.reshape(WINDOW, -1)
            mine = picked(met, word, run, n_runs)
            g = gradients(p, np.concatenate([x[:, own], embedded(p, *mine)[at]], axis=2), live[:, own], label[k], np.ones(k.size, np.float32))
            dx = g.pop("x")[:, :, COUNTED:].reshape(-1, 2 * EMBED)
            g["ew"], g["eg"] = scattered(np.stack([np.bincount(at.ravel(), dx[:, c], met.size) for c in range(2 * EMBED)], axis=1), *mine)
            g["ew"] += DECAY / y.size * p["ew"]
            g["eg"] += DECAY / y.size * p["eg"]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
            for name, d in g.items():
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    clean = np.clip(np.concatenate([scores(crossed[k], texts.filter(pa.array((y == 0) & (half == k))), TRAIN_BYTES) for k in (0, 1)]), 1e-9, 1 - 1e-9)
    same = np.clip(scores(model, texts.filter(pa.array(y == 0)), TRAIN_BYTES), 1e-9, 1 - 1e-9)
    high = max(np.quantile(c, 1 - CLEAN_FLAGGED, method="higher") for c in (clean, same))
    p["bo"] -= np.float32(max(0.0, np.log(high / (1 - high)) - np.log(THRESHOLD / (1 - THRESHOLD)) + 1e-3))
    return model


def scores(model: Model | None, texts: pa.Array, most: int = bytescan.PASS_BYTES) -> np.ndarray:
    """The worst window's score of each text, in passes of about so many bytes."""
    data, offsets = bytescan.raw(texts)
    out = np.zeros(offsets.size - 1)
    if model is None:
        return out
    for lo, hi in bytescan.passes(offsets, most):
        low, start, end, doc = letters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not start.size:
            continue
        once, back, s, e = distinct(low, start, end)
        table = project(model.p, model.inputs(low, once, s, e))
        text, first, length = windows(np.bincount(doc, minlength=hi - lo))
        logit = np.empty(text.size, np.float32)
        order = np.argsort(length != WINDOW, kind="stable")  # full windows need no mask
        full = int((length == WINDOW).sum())
        for k, j in [*((k, min(k + CHUNK, full)) for k in range(0, full, CHUNK)), *((k, min(k + CHUNK, order.size)) for k in range(full, order.size, CHUNK))]:
            own = order[k:j]
            at = back[np.minimum(first[own][None, :] + np.arange(WINDOW)[:, None], back.size - 1)]
            live = None if j <= full else np.arange(WINDOW)[:, None] < length[own][None, :]
            logit[own], _ = forward(model.p, [t[at] for t in table], live)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[lo + text[heads]] = _sigmoid(np.maximum.reduceat(logit, heads).astype(np.float64))
    return out


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Trains on at most `sample` labelled documents of each label, those of least hash; held-out ones are never read."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = own.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("o", F.xxhash64("doc_id"))
    known = common.table(known, "toxicity-labels")
    chosen = known.where("y = 0").orderBy("o", "doc_id").limit(sample).unionByName(known.where("y > 0").orderBy("o", "doc_id").limit(sample))
    chosen = common.table(chosen.select("doc_id", "y"), "toxicity-sample")
    rows = common.texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toArrow()  # at most 2 * sample rows
    rows = rows.sort_by("doc_id")
    texts, y = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), np.array([int(v > 0) for v in rows.column("y").to_pylist()])
    del rows  # the texts stand once while the network is trained
    common.give_back()
    model = train(texts, y)
    del texts
    common.give_back()  # the driver's memory is the later stages' too
    return model


def score_documents(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(model, b.column("text")))], ["doc_id", "score"])

    return common.texts_of(docs, id_col, text_col).transform(common.map_batches, run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(model, b.column(text_col)) < threshold))

    return docs.transform(common.map_batches, run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of the labelled ones outside the held-out third."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score_documents(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
