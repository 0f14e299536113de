"""Centroid clustering by Exponion search over whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower one of that to all others, from
round to round. Only vectors whose bounds meet look further, and then at centroids inside a ball around their
own: with u the distance to it and d its distance to the nearest other one, nothing beyond 2 u + d can be
nearest or second. Each centroid's list of the others by distance gives the ball; its radius is inclusive and
bounds are widened for rounding, so ties stay within it, and the smallest squared distance, then the smallest
number, wins in exact whole numbers.

A round is one pass without a shuffle; only vectors that changed their cluster send a change of its sums. The
driver and each task hold the centroids and their distances to each other, which MOST_CENTROIDS bounds.
Vectors stay in the shared folder, a table for each round.

Kept are vectors of exactly `length` components, none null or non-finite; others are left out. Repeated rows
count each; a null vec_id stays null and is no first centroid unless others are too few. With fewer kept vectors
than k there are as many centroids. Components whose whole number lies beyond 2^27 are an error: their
distances don't fit a long. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, short, staged, table

#: Centroids: their distances to each other are at most 32 MB.
MOST_CENTROIDS = 2048
#: Whole numbers up to here have squared distances that fit a long; up to EXACT doubles hold them too.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Bounds are widened by this share, far more than roundings add up to.
SLACK = 1e-9
ROWS = 4096


def whole(vectors: pa.Array, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of each component as double."""
    x = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} / {scale}: squared distances don't fit a long")
    return x.astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT:
        x, y = x.astype(np.float64), y.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], axis=1)


class Centroids:
    """The centroids of a round, with each one's list of all by distance from it; moved: how far each came from its place before."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        self.apart = np.sqrt(squared(points, points).astype(np.float64))
        np.fill_diagonal(self.apart, -1.0)  # each stands first in its own list
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.near = np.take_along_axis(self.apart, self.order, axis=1)
        self.gap = self.near[:, 1] if len(points) > 1 else np.full(len(points), np.inf)
        moved = np.sqrt(((points - before) ** 2).sum(1).astype(np.float64)) if before is not None else np.zeros(len(points))
        self.moved = moved * (1 + SLACK)
        top = np.sort(self.moved)[::-1]
        #: The furthest that any other centroid moved.
        self.others = np.where(self.moved == top[0], top[1] if len(top) > 1 and (self.moved == top[0]).sum() == 1 else top[0], top[0])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector and both bounds, from those of the round before; and how many distances that took."""
        own, upper, lower = own.copy(), upper + self.moved[own], lower - self.others[own]
        taken = 0
        safe = np.maximum(lower, self.gap[own] / 2) * (1 - SLACK)
        todo = np.flatnonzero(upper >= safe)
        upper[todo] = np.sqrt(((x[todo] - self.points[own[todo]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        taken += len(todo)
        todo = todo[upper[todo] >= safe[todo]]
        for a in np.unique(own[todo]).tolist():
            mine = todo[own[todo] == a]
            inside = np.searchsorted(self.near[a], (2 * upper[mine] + self.gap[a]) * (1 + SLACK), side="right")
            # Balls of similar size are searched together; one more centroid than the ball holds does no harm.
            size = np.minimum(len(self.points), 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64))
            for m in np.unique(size).tolist():
                rows = mine[size == m]
                near = np.sort(self.order[a, :m])  # in ascending order, so the first of equals is the smallest number
                d = squared(x[rows], self.points[near])
                taken += d.size
                best = d.argmin(axis=1)
                own[rows] = near[best]
                at = np.arange(len(rows))
                upper[rows] = np.sqrt(d[at, best].astype(np.float64)) * (1 + SLACK)
                d[at, best] = np.iinfo(np.int64).max
                # Beyond the ball nothing is nearer than the second within it.
                lower[rows] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if m > 1 else np.inf
        return own, upper, lower, taken


_STATE = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("before", pa.int32()), ("own", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64())])
_STATE_SQL = "vec_id bigint, x binary, before int, own int, upper double, lower double, distance bigint"


def _numbers(x: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def _first(scale: int, dim: int):
    """Whole numbers of each vector, with bounds that say nothing yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, ROWS):
            x, n = whole(batch.column(1), scale, dim), batch.num_rows
            raw = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
            cols = [batch.column(0), raw, pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=_STATE)

    return run


def _round(centroids: Centroids, dim: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, ROWS):
            x = _numbers(batch.column("x"), dim)
            was, upper, lower = (batch.column(c).to_numpy() for c in ("own", "upper", "lower"))
            own, upper, lower, _ = centroids.assign(x, was, upper, lower)
            distance = ((x - centroids.points[own]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
            before = np.full(len(x), -1, np.int32) if first else was
            cols = [batch.column("vec_id"), batch.column("x"), pa.array(before, pa.int32()), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(cols, schema=_STATE)

    return run


def _changes(k: int, dim: int):
    """(cluster, n, sums): what a task's vectors add to the clusters that they come to and take from those they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in short(batches, ROWS):
            x, before, own = _numbers(batch.column("x"), dim), batch.column("before").to_numpy(), batch.column("own").to_numpy()
            for at, sign in ((own, 1), (before, -1)):
                some = at >= 0
                np.add.at(sums, at[some], sign * x[some])
                n += sign * np.bincount(at[some], minlength=k)
        hit = np.flatnonzero((n != 0) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[hit]), pa.array(sums[hit].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def kept(vector: Column, length: int) -> Column:
    return F.coalesce((F.size(vector) == length) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def exponion(vectors: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The last round's state, (vec_id, x, before, own, upper, lower, distance) of each kept vector, and the centroids."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must lie between 1 and {MOST_CENTROIDS}")
    bounded(vectors.sparkSession)
    rows = vectors.select(column(id_col).cast("bigint").alias("vec_id"), column(vector_col).alias("x")).where(kept(F.col("x"), length))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # Of rows that share a vec_id the smallest vector comes first.
    seeds = rows.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").toArrow()
    points = whole(seeds.column("x").combine_chunks(), scale, length) if seeds.num_rows else np.zeros((0, length), np.int64)
    state = staged(rows.mapInArrow(_first(scale, length), _STATE_SQL), "cluster-vectors")
    centroids = Centroids(points) if len(points) else None
    n, sums = [0] * len(points), [[0] * length for _ in points]
    for turn in range(rounds + 1):
        if centroids is None:
            break
        state = staged(state.mapInArrow(_round(centroids, length, turn == 0, turn == rounds), _STATE_SQL), f"cluster-round-{turn}")
        if turn == rounds:
            break
        changed = state.where("own != before").select("x", "before", "own").mapInArrow(_changes(len(points), length), "cluster int, n bigint, sums array<bigint>")
        total = changed.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(length)]).alias("sums"))
        for row in total.collect():  # a row for each centroid at most
            n[row.cluster] += row.n
            sums[row.cluster] = [a + b for a, b in zip(sums[row.cluster], row.sums, strict=True)]
        before, points = points, np.array([[v // c for v in s] if c else p.tolist() for s, c, p in zip(sums, n, points, strict=True)], np.int64)
        centroids = Centroids(points, before)
    return state, points


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = vectors.sparkSession
    state, points = exponion(vectors, **parameters)
    sums = {r.own: r.d for r in state.groupBy("own").agg(F.sum("distance").alias("d")).collect()}
    told = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist()) if c in sums]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", F.col("own").alias("cluster"), "distance").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _assigned_sql(turn: int) -> str:
    return f"""near{turn} AS MATERIALIZED (
        SELECT v.vec_id, v.x, arg_min(c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 100 + c.cluster) AS cluster,
            min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)) AS distance
        FROM v CROSS JOIN c{turn} c GROUP BY v.row, v.vec_id, v.x)"""


def _moved_sql(turn: int) -> str:
    return f"""sums{turn} AS MATERIALIZED (
        SELECT cluster, i, sum(x[i]) AS total, count(*) AS n FROM near{turn - 1}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
    c{turn} AS MATERIALIZED (
        SELECT c.cluster, coalesce((SELECT list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) FROM sums{turn} s WHERE s.cluster = c.cluster), c.x) AS x FROM c{turn - 1} c)"""


#: Every vector against every centroid in each round: fit for the small tables of the comparison only.
SQL = f"""WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 16)),
    {_assigned_sql(0)}, {_moved_sql(1)}, {_assigned_sql(1)}, {_moved_sql(2)}, {_assigned_sql(2)}, {_moved_sql(3)}, {_assigned_sql(3)}
    SELECT n.vec_id, n.cluster, n.distance, CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(n.distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM near3 n JOIN c3 c USING (cluster)"""
