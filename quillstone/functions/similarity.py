"""Jaro-Winkler similarity, the one function that Spark lacks, over arrays of pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a letter in a name's mark: so many of its occurrences count, the rest are counted together.
LETTERS, BLANKS, OTHERS = 4, 4, 2
#: Code units of both sides that pairs take at once.
UNITS = 1 << 21


@dataclass
class Names:
    """Names as arrays: code points in columns, lengths, and marks of which letters each holds how often."""

    codes: np.ndarray
    length: np.ndarray
    marks: np.ndarray
    beyond: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Names:
        length = np.array([len(n) for n in names], np.int64)
        width = max(1, int(length.max(initial=0)))
        codes = np.array(names, f"<U{width}").view(np.uint32).reshape(len(names), width) if names else np.zeros((0, 1), np.uint32)
        inside = np.arange(width) < length[:, None]
        # Letters, the blank, and ten classes of whatever else.
        kind = np.where((codes >= 97) & (codes <= 122), codes - 97, np.where(codes == 32, 26, 27 + codes % 10)).astype(np.int64)
        counts = np.zeros((len(names), 37), np.int64)
        np.add.at(counts, (np.repeat(np.arange(len(names)), inside.sum(1)), kind[inside]), 1)
        slots = [LETTERS] * 26 + [BLANKS] + [OTHERS] * 10
        marks, at = np.zeros((len(names), 2), np.uint64), 0
        for k, n in enumerate(slots):
            for t in range(n):
                marks[:, at // 64] |= (counts[:, k] > t).astype(np.uint64) << np.uint64(at % 64)
                at += 1
        return cls(codes, length, marks, np.maximum(counts - np.array(slots), 0).sum(1))

    def take(self, at: np.ndarray) -> Names:
        return Names(self.codes[at], self.length[at], self.marks[at], self.beyond[at])


def same_beginning(a: Names, b: Names) -> np.ndarray:
    """Equal first letters of each pair, four at most."""
    out = np.zeros(len(a.length), np.int64)
    on = np.ones(len(out), bool)
    for i in range(min(4, a.codes.shape[1], b.codes.shape[1])):
        on = on & (a.codes[:, i] == b.codes[:, i]) & (i < a.length) & (i < b.length)
        out += on
    return out


def jaro(a: Names, b: Names) -> np.ndarray:
    """Letters match where equal within a reach of half the longer name, each once; of both sides' matches those out of order count half."""
    n, rows, cols = len(a.length), np.arange(len(a.length)), np.arange(b.codes.shape[1])
    reach = np.maximum(0, np.maximum(a.length, b.length) // 2 - 1)[:, None]
    free, kept = cols < b.length[:, None], np.zeros(a.codes.shape, bool)
    for i in range(int(a.length.max(initial=0))):
        hit = free & (cols >= i - reach) & (cols <= i + reach) & (b.codes == a.codes[:, i : i + 1]) & (i < a.length)[:, None]
        some = hit.any(1)
        free[rows[some], hit.argmax(1)[some]] = False
        kept[:, i] = some
    taken = (cols < b.length[:, None]) & ~free
    m = kept.sum(1)
    most = int(m.max(initial=0))
    in_order = lambda codes, on: np.take_along_axis(codes, np.argsort(~on, axis=1, kind="stable"), 1)[:, :most]
    swaps = ((in_order(a.codes, kept) != in_order(b.codes, taken)) & (np.arange(most) < m[:, None])).sum(1) // 2
    with np.errstate(all="ignore"):
        score = (m / a.length + m / b.length + (m - swaps) / m) / 3
    return np.where((a.length == 0) & (b.length == 0), 1.0, np.where(m > 0, score, np.zeros(n)))


def jaro_winkler_of(a: Names, b: Names) -> np.ndarray:
    """Jaro of each pair, raised by a tenth of the rest for each of up to four equal first letters; up to 0.7 it stays as it is."""
    s = jaro(a, b)
    return np.where(s <= 0.7, s, s + 0.1 * same_beginning(a, b) * (1 - s))


def jaro_winkler_score(a: str, b: str) -> float:
    return float(jaro_winkler_of(Names.of([a]), Names.of([b]))[0])


def least_jaro(threshold: float, same: int) -> float:
    """What Jaro must be at least where so many first letters are equal: they add a tenth of the rest each, but only above 0.7."""
    return min(threshold, max(0.7, (threshold - 0.1 * same) / (1 - 0.1 * same)))


def near_pairs(a: Names, b: Names, threshold: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of a, row of b, score) of all pairs that reach the threshold, and the number of pairs that were scored.

    With m letters in common, Jaro is at most (m / |a| + m / |b| + 1) / 3. Two marks' common bits, and the letters
    beyond them, bound m. Only pairs within the bound for their beginning are formed.
    """
    least = np.array([3 * least_jaro(threshold, k) - 1 for k in range(5)]) - 1e-9
    found, scored = [], 0
    for at in range(0, len(a.length), rows):
        part = slice(at, at + rows)
        common = np.minimum(a.beyond[part, None], b.beyond[None, :])
        for w in range(2):
            common = common + np.bitwise_count(a.marks[part, w, None] & b.marks[None, :, w])
        with np.errstate(all="ignore"):
            bound = common * (1 / a.length[part, None] + 1 / b.length[None, :])
        begin = a.codes[part, :1] == b.codes[None, :, 0]
        i, j = np.nonzero(bound >= np.where(begin, least[4], least[0]))
        same = same_beginning(Names(a.codes[at + i, :4], a.length[at + i], None, None), Names(b.codes[j, :4], b.length[j], None, None))
        keep = bound[i, j] >= least[same]
        i, j = i[keep] + at, j[keep]
        scored += len(i)
        step = max(1, UNITS // (a.codes.shape[1] + b.codes.shape[1]))
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            s = jaro_winkler_of(a.take(x), b.take(y))
            hit = s >= threshold
            found.append((x[hit], y[hit], s[hit]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return *(np.concatenate(c) for c in zip(none, *found, strict=True)), scored
