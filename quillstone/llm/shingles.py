"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow batch.

Words are runs of bytes other than blanks 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial over random byte values modulo 2^64, from prefix sums over the whole batch; a shingle's hash
mixes those of its words. Two different shingles agree with a chance of about 2^-60.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_COEF = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input bears on every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def batch_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a string array's texts in order, and offsets (len + 1) of each text's share; repeats within a text stay."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + total]
    offsets = offsets - base
    blank = _BLANK[data]
    edge = np.zeros(total + 1, bool)
    edge[offsets] = True
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = word
    last[:-1] &= blank[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(total)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:total], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    counts = np.diff(at)
    whole = np.zeros(0, np.uint64)
    if len(words) >= width:
        m = len(words) - width + 1
        whole = words[:m] * _COEF[0]
        for k in range(1, width):
            whole = whole + words[k : k + m] * _COEF[k]
        whole = mix(whole)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    long = counts >= width
    if long.any():
        src = np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(each[long])[:-1]]), each[long]) + np.arange(int(each[long].sum()))
        dst = np.repeat(out_at[:-1][long] - np.concatenate([[0], np.cumsum(each[long])[:-1]]), each[long]) + np.arange(int(each[long].sum()))
        out[dst] = whole[src]
    for i in np.flatnonzero((counts > 0) & ~long).tolist():
        w = words[at[i] : at[i + 1]]
        out[out_at[i] : out_at[i] + 1] = mix((w * _COEF[: len(w)]).sum(keepdims=True, dtype=np.uint64) + _COEF[-len(w)])
    return out, out_at


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null texts and texts without a word."""
    hashes, at = batch_shingles(texts, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out
