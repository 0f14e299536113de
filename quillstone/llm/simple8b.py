"""Token ids in word-aligned Simple-8b files.

File: 8 magic bytes; 64-bit words; the table of blocks (first word of each, unsigned 64-bit); the table of
documents (doc_id, whether it is null, first id, each 64-bit); then a tail of five 64-bit numbers (ids,
words, documents, ids per block, format version). All numbers are little-endian.

A word's low four bits select how many ids its other 60 bits hold and how wide each is. Selector 0 is the
escape: the next word is one id of up to 64 bits. Selector 1 stands for 120 zeros. A block of ids begins at
a word of its own, so blocks are encoded and decoded side by side and read by range.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8BWORD1"
BLOCK_IDS = 1024
#: Ids in a word and bits of each, by selector; fixed values of the format.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(0, n, block_ids)
    stops = np.minimum(starts + block_ids, n)
    block_stop = np.repeat(stops, stops - starts)
    position = np.arange(n)
    choice = np.zeros(n, np.int8)  # the escape
    step = np.ones(n, np.int64)
    open_ = np.ones(n, bool)
    for s in range(1, 16):
        wide = ids >= np.uint64(1 << BITS[s]) if BITS[s] else ids > 0
        if n - int(wide.sum()) == 0:
            continue
        bad = np.concatenate([[0], np.cumsum(wide)])
        end = np.minimum(position + COUNTS[s], block_stop)
        fits = open_ & (bad[end] == bad[:-1])
        if BITS[s] == 0:
            fits &= end - position == COUNTS[s]
        choice[fits], step[fits] = s, (end - position)[fits]
        open_ &= ~fits
        if not open_.any():
            break
    jump = position + step
    heads, at = [], starts
    while len(at):  # all blocks step on together
        heads.append(at)
        at = jump[at]
        live = at < stops
        at, stops = at[live], stops[live]
    heads = np.sort(np.concatenate(heads))
    selector = choice[heads].astype(np.int64)
    width = 1 + (selector == 0)
    first = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        on = np.flatnonzero(selector == s)
        if s == 0:
            words[first[on] + 1] = ids[heads[on]]
            continue
        word = np.full(len(on), s, np.uint64)
        for k in range(COUNTS[s] if BITS[s] else 0):
            inside = k < step[heads[on]]
            value = np.where(inside, ids[np.minimum(heads[on] + k, n - 1)], np.uint64(0))
            word |= value << np.uint64(4 + k * BITS[s])
        words[first[on]] = word
    return words, first[np.searchsorted(heads, starts)]


def decode(words: np.ndarray, block_words: np.ndarray, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of consecutive blocks, given the first word of each."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that an escape has made ids; an escape within a run of zeros-words is found in order
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    counts = np.array(COUNTS)[selector[heads]]
    block = np.searchsorted(block_words, heads, side="right") - 1
    total = np.cumsum(counts) - counts
    base = total[np.searchsorted(heads, block_words)]
    at = block * block_ids + total - base[block]
    stop = np.minimum((block + 1) * block_ids, n)
    for s in np.unique(selector[heads]).tolist():
        on = np.flatnonzero(selector[heads] == s)
        if s == 0:
            out[at[on]] = words[heads[on] + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s] if BITS[s] else 0):
            inside = at[on] + k < stop[on]
            out[at[on][inside] + k] = (words[heads[on][inside]] >> np.uint64(4 + k * BITS[s])) & mask
    return out


class Writer:
    """Writes documents one after another; ids are encoded in runs of whole blocks."""

    def __init__(self, out, flush_ids: int = 1 << 19):
        self.out, self.flush_ids = out, flush_ids // BLOCK_IDS * BLOCK_IDS
        out.write(MAGIC)
        self.pending: list[bytes] = []
        self.held = self.ids = self.words = 0
        self.blocks: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """raw: the document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id or 0, int(doc_id is None), self.ids))
        self.pending.append(raw)
        self.ids += len(raw) // 4
        self.held += len(raw) // 4
        if self.held >= self.flush_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        cut = len(ids) if last else len(ids) // self.flush_ids * self.flush_ids
        words, blocks = encode(ids[:cut])
        self.out.write(words.astype("<u8").tobytes())
        self.blocks.append(blocks + self.words)
        self.words += len(words)
        self.pending, self.held = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.concatenate(self.blocks).astype("<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(np.array([self.ids, self.words, len(self.docs), BLOCK_IDS, 1], "<u8").tobytes())


class Reader:
    """Reads a file by ranges: its tables first, then the blocks asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a Simple-8b file")
        self.ids, self.words, docs, self.block_ids, _ = np.frombuffer(source.read_at(40, size - 40), "<u8").astype(np.int64).tolist()
        blocks = -(-self.ids // self.block_ids)
        at = 8 + 8 * self.words
        self.blocks = np.frombuffer(source.read_at(8 * blocks, at), "<u8").astype(np.int64)
        self.docs = np.frombuffer(source.read_at(24 * docs, at + 8 * blocks), "<i8").reshape(docs, 3)

    def read(self, first: int, count: int) -> np.ndarray:
        """Ids first to first + count - 1."""
        if not count:
            return np.zeros(0, np.uint64)
        a, b = first // self.block_ids, -(-(first + count) // self.block_ids)
        w0, w1 = int(self.blocks[a]), int(self.blocks[b]) if b < len(self.blocks) else self.words
        words = np.frombuffer(self.source.read_at(8 * (w1 - w0), 8 + 8 * w0), "<u8")
        n = min(b * self.block_ids, self.ids) - a * self.block_ids
        return decode(words, self.blocks[a:b] - w0, n, self.block_ids)[first - a * self.block_ids :][:count]
