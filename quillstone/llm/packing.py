"""Packing documents into sequences by non-negative least squares over length combinations.

1. One pass encodes each document, adds its end id and cuts it into full windows and a remainder. Only the
   remainder's ids are kept, beside checksums of what is cut; lengths are ranked within the task.
2. The histogram of remainders (at most window - 1 numbers) is all that reaches the driver. Shallow
   combinations of two and three lengths that fill a window are enumerated; their repeat counts solve
   min |A x - h|, x >= 0, by projected gradient steps; they are rounded down so that no length is overdrawn.
3. Ranks become global by adding each task's share of every length before it. A remainder's rank says to
   which repeat of which combination it goes: no list of pieces is gathered anywhere.
4. Remainders beyond the combinations are laid end to end in order of length and rank and cut at window
   boundaries; only the ids of those that are cut are looked at again.

A null text counts as empty: its document is the end id alone. Repeated rows are packed each. Extra columns
are ignored; an empty table gives no rows. A null doc_id is packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, short, staged, table
from quillstone.llm.vocab import ByteBpe, default_path, loaded

_CUT = "doc_id bigint, part int, row bigint, doc_tokens bigint, full_before bigint, crcs array<bigint>, rest int, rest_rank bigint, rest_crc bigint, rest_ids binary"


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = loaded(ByteBpe, path), TaskContext.get().partitionId()
        wide = "<u2" if len(enc.lengths) <= 1 << 16 else "<u4"
        ranks, full, row = np.zeros(window, np.int64), 0, 0
        for batch in short(batches):
            out: list[list] = [[] for _ in range(10)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), end_id).astype("<u4")
                whole, rest = divmod(len(ids), window)
                tail = ids[whole * window :]
                crcs = [zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(whole)]
                for column, x in zip(out, (doc, part, row, len(ids), full, crcs, rest, int(ranks[rest]), zlib.crc32(tail.tobytes()), tail.astype(wide).tobytes()), strict=True):
                    column.append(x)
                ranks[rest] += 1
                full += whole
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [x.split(" ")[0] for x in _CUT.split(", ")])

    return run


def combinations(window: int, histogram: np.ndarray) -> np.ndarray:
    """Pairs and triples (padded with 0) of lengths present in the histogram that fill a window exactly."""
    present = histogram > 0
    out = [(a, window - a, 0) for a in range(window // 2, window) if present[a] and window - a > 0 and present[window - a]]
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c >= 1)
    a, b, c = a[keep], b[keep], c[keep]
    keep = present[a] & present[b] & present[c]
    return np.concatenate([np.array(out, np.int64).reshape(-1, 3), np.stack([a[keep], b[keep], c[keep]], axis=1)])


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts of the combinations: non-negative least squares by accelerated projected gradients, rounded down within the histogram."""
    if not len(combos):
        return np.zeros(0, np.int64)
    size = len(histogram)
    used = [(combos[:, k], combos[:, k] > 0) for k in range(3)]

    def spend(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c[on], x[on], size) for c, on in used)

    degree = np.bincount(combos[combos > 0], minlength=size).max()
    step = 1.0 / (3.0 * degree)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        miss = spend(y) - histogram
        miss[0] = 0
        grad = sum(np.where(on, miss[c], 0.0) for c, on in used)
        new = np.maximum(0.0, y - step * grad)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    counts = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64) - spend(counts.astype(float)).astype(np.int64)
    # What rounding overdrew is given back; then whole windows that still fit are added, most weighty combinations first.
    order = np.argsort(-x, kind="stable").tolist()
    for i in reversed(order):
        while counts[i] and any(left[c] < 0 for c in combos[i] if c):
            counts[i] -= 1
            for c in combos[i]:
                if c:
                    left[c] += 1
    for i in order:
        need = np.bincount(combos[i][combos[i] > 0], minlength=1)
        lengths = np.flatnonzero(need)
        more = int((left[lengths] // need[lengths]).min())
        if more > 0:
            counts[i] += more
            left[lengths] -= more * need[lengths]
    return counts


class Plan:
    """Where the piece of a given length and global rank goes."""

    def __init__(self, window: int, histogram: np.ndarray):
        self.window = window
        combos = combinations(window, histogram)
        counts = solve(combos, histogram)
        combos, counts = combos[counts > 0], counts[counts > 0]
        first = np.concatenate([[0], np.cumsum(counts)])
        self.windows = int(first[-1])
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
        for (a, b, c), n, at in zip(combos.tolist(), counts.tolist(), first.tolist(), strict=False):
            for length, offset in ((a, 0), (b, a), (c, a + b)):
                if length:
                    slots[length].append((n, at, offset))
        self.slots = [(np.cumsum([0, *(s[0] for s in x)]), np.array([s[1] for s in x], np.int64), np.array([s[2] for s in x], np.int64)) for x in slots]
        self.planned = np.array([int(x[0][-1]) for x in self.slots], np.int64)
        left = histogram.astype(np.int64) - self.planned
        left[0] = 0
        self.before = np.concatenate([[0], np.cumsum(left * np.arange(window))])[:-1]
        self.loose = int((left * np.arange(window)).sum())

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, start among the loose ids or -1) for each piece."""
        seq, off, loose = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.full(len(length), -1, np.int64)
        for n in np.unique(length).tolist():
            if not n:
                continue
            at = np.flatnonzero(length == n)
            bounds, firsts, offsets = self.slots[n]
            fits = rank[at] < self.planned[n]
            hit = at[fits]
            k = np.searchsorted(bounds, rank[hit], side="right") - 1
            seq[hit], off[hit] = firsts[k] + rank[hit] - bounds[k], offsets[k]
            rest = at[~fits]
            loose[rest] = self.before[n] + (rank[rest] - self.planned[n]) * n
        return seq, off, loose


_PIECES = "doc_id bigint, part int, row bigint, doc_tokens bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, cut int"


def _pieces(plan: Plan, full_total: int):
    window = plan.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("part", "row", "doc_tokens", "full_at", "rest", "rank", "rest_crc")}
            seq, off, loose = plan.place(num["rest"], num["rank"])
            rows: list[tuple] = []
            for i, (doc, crcs) in enumerate(zip(col["doc_id"].to_pylist(), col["crcs"].to_pylist(), strict=True)):
                head = (doc, int(num["part"][i]), int(num["row"][i]), int(num["doc_tokens"][i]))
                for k, crc in enumerate(crcs):
                    rows.append((*head, k * window, window, crc, int(num["full_at"][i]) + k, 0, 0))
                start, rest = len(crcs) * window, int(num["rest"][i])
                if not rest:
                    continue
                if loose[i] < 0:
                    rows.append((*head, start, rest, int(num["rest_crc"][i]), full_total + int(seq[i]), int(off[i]), 0))
                    continue
                s, o = divmod(int(loose[i]), window)
                one = min(rest, window - o)
                base = full_total + plan.windows + s
                rows.append((*head, start, one, int(num["rest_crc"][i]) if one == rest else None, base, o, 0 if one == rest else 1))
                if one < rest:
                    rows.append((*head, start + one, rest - one, None, base + 1, 0, 2))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.int32()), strict=True)], [x.split(" ")[0] for x in _PIECES.split(", ")])

    return run


def _crc_of_cut(wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            crcs = []
            for raw, cut, length in zip(col["rest_ids"].to_pylist(), col["cut"].to_pylist(), col["length"].to_pylist(), strict=True):
                ids = np.frombuffer(raw, wide).astype("<u4")
                crcs.append(zlib.crc32((ids[:length] if cut == 1 else ids[-length:]).tobytes()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(crcs, pa.int64()) if n == "ids_crc32" else col[n] for n in names], names)

    return run


def packed(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    path = vocabulary or default_path("byte_bpe_50k.json")
    bounded(docs.sparkSession)
    cut = staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(path, window, end_id), _CUT), "pack-cut")
    lengths = cut.groupBy("part", "rest").agg(F.count("*").alias("c"))
    windows = cut.groupBy("part").agg(F.max(F.col("full_before") + F.size("crcs")).alias("c"))
    counts = staged(lengths.unionByName(windows.select("part", F.lit(window).alias("rest"), "c")), "pack-counts")
    total = {r["rest"]: r["c"] for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most window + 1 rows
    histogram = np.array([0, *(total.get(n, 0) for n in range(1, window))], np.int64)
    plan = Plan(window, histogram)
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c"))
    per_part = before.select("part", "rest", "before")
    fulls = before.where(F.col("rest") == window).select("part", F.col("before").alias("full_base"))
    light = cut.drop("rest_ids").join(per_part, ["part", "rest"]).join(fulls, "part")
    light = light.select("doc_id", "part", "row", "doc_tokens", "crcs", "rest", "rest_crc", (F.col("full_base") + F.col("full_before")).alias("full_at"), (F.col("before") + F.col("rest_rank")).alias("rank"))
    pieces = light.mapInArrow(_pieces(plan, total.get(window, 0)), _PIECES)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not plan.loose:
        return pieces.select(*out)
    pieces = staged(pieces, "pack-pieces")
    wide = "<u2" if len(loaded(ByteBpe, path).lengths) <= 1 << 16 else "<u4"
    again = pieces.where("cut > 0").join(cut.select("part", "row", "rest_ids"), ["part", "row"]).select(*out, "cut", "rest_ids")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return pieces.where("cut = 0").select(*out).unionByName(again.mapInArrow(_crc_of_cut(wide), schema))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
