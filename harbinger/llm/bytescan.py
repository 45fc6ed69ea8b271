"""Words and their 64-bit hashes over the raw bytes of Arrow string columns, many texts at a time; exact numbers of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that one pass looks at; a longer text is a pass of its own.
PASS_BYTES = 1 << 21

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i under n at least; kept, as every pass needs them."""
    have = _POWERS.get(base)
    if have is None or have.size < n:
        size = max(n, PASS_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * PASS_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text starts and the last ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_utf8())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes."""
    lo, n = 0, offsets.size - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than white space (space, tab to carriage return)."""
    if not data.size:
        none = np.empty(0, np.int64)
        return none, none, none
    full = (data != 32) & ((data < 9) | (data > 13))
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    inner = offsets[(offsets > 0) & (offsets < data.size)]  # a word ends with its text
    begins[inner] |= full[inner]
    ends[inner - 1] |= full[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z become a to z; all other bytes stay."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


class Blocks(NamedTuple):
    """Spans of bytes as words of eight bytes, the last of each filled with zeros: all words, which span each is of, and
    each span's first word, number of words and number of bytes."""

    value: np.ndarray
    span: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray


def blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Blocks:
    size = end - start
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    span = np.repeat(np.arange(size.size), count)
    done = 8 * (np.arange(span.size) - first[span])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray((data.size + 1,), "<u8", padded, strides=(1,))[start[span] + done].astype(np.uint64)
    spare = np.maximum(0, 8 - (size[span] - done)).astype(np.uint64) << np.uint64(3)
    return Blocks(value << spare >> spare, span, first, count, size)


def block_hashes(b: Blocks, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span by its words of eight bytes, each mixed by itself with its place, so that no equation
    between sums holds for all texts of some form. Spans that differ have one hash only by chance."""
    if not b.size.size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        place = (np.arange(b.span.size) - b.first[b.span] + 1).astype(np.uint64) * np.uint64(_P)
        h = mix(mix(b.value ^ place ^ np.uint64(seed * _PINV % (1 << 64))) + place)
        sums = np.zeros(b.size.size, np.uint64)
        full = np.flatnonzero(b.count)
        sums[full] = np.add.reduceat(h, b.first[full]) if full.size else 0
        return mix(sums ^ mix(b.size.astype(np.uint64) + np.uint64(seed)))


def same_spans(a: Blocks, i: np.ndarray, b: Blocks, j: np.ndarray) -> np.ndarray:
    """Whether span i[k] of a and span j[k] of b are the same bytes."""
    out = a.size[i] == b.size[j]
    some = np.flatnonzero(out)
    count = a.count[i[some]]
    own = np.repeat(some, count)
    within = np.arange(own.size) - np.repeat(np.cumsum(count) - count, count)
    differ = a.value[a.first[i[own]] + within] != b.value[b.first[j[own]] + within]
    out[own[differ]] = False
    return out


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, equal exactly where the bytes are; hashes only find what is then compared."""
    b = blocks(data, start, end)
    once, first, back = np.unique(block_hashes(b), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(b, np.arange(b.size.size), b, first[back]))
    if odd.size:  # two spans of one hash
        body, seen = data.tobytes(), {}
        for k in odd.tolist():
            back[k] = once.size + seen.setdefault(body[start[k] : end[k]], len(seen))
    return back


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A quick 64-bit hash of each span of bytes, the same wherever the span stands. Different spans can be made to have
    one hash, so this is for counting features, not for telling texts apart."""
    if not start.size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, data.size)[: data.size], out=sums[1:])
        h = (sums[end] - sums[start]) * _powers(_PINV, data.size)[start]
        return mix(h ^ mix((end - start).astype(np.uint64)))
