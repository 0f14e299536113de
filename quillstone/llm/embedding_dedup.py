"""Near-duplicate embeddings by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of seeded sign flips and a fast Hadamard
transform; its hash is the signed axis nearest to it. A table joins two such hashes, and each vector also
enters the buckets of the second nearest axes (multiprobe). Vectors that meet in a bucket are compared by
cosine in double precision; a pair is counted in the first bucket in which it meets, so no table of pairs
is needed to count links once. Large buckets are compared block by block, and many small ones in one call.

A label of more vectors joins more hashes, so that a bucket of unlike vectors holds some 64 of them at every
size, and has more tables, so that the share of pairs found stays: a pair of cosine 0.93 in 64 dimensions meets
in a table of two hashes with a chance of 0.72, of three 0.55, of four 0.41.

Vectors of unequal labels or lengths never link. Rows with a null label, and vectors that are null, empty,
zero or hold null or non-finite components, link with nothing. Equal vectors of a label are one node with a
weight. A null vec_id has no links and a null component. An empty table gives no rows; extra columns are
ignored. Pairs found are verified, so none lies below the threshold; tests measure the share found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, short, staged, table
from quillstone.llm.components import components

#: Vectors of a block; unlike vectors that a bucket may hold; rows that a call compares.
BLOCK, BUCKET, CALL_ROWS = 256, 64, 8192
#: Pairs whose cosine is taken at once.
PAIRS = 1 << 16


def tables_of(hashes: int) -> int:
    """Tables that find some 0.99 of the pairs at the threshold: each further hash takes half as many again."""
    return math.ceil(3 * 1.5 ** (hashes - 1))


def hashes_of(n: Column, dim: Column) -> Column:
    """Hashes joined for n vectors: two, or as many as bring n / (2 d) ** hashes below BUCKET."""
    wide = F.lit(2.0) * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(dim, F.lit(2)).cast("double"))))
    return F.greatest(F.lit(2), F.ceil(F.log(n / F.lit(float(BUCKET))) / F.log(wide))).cast("int")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def bucket_codes(x: np.ndarray, hashes: int, seed: int = 7) -> np.ndarray:
    """(rows, tables, 1 + hashes) codes of the buckets that each unit vector enters: its own first, then one for the second choice of each hash."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    tables = tables_of(hashes)
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64([seed, d]))
    out = np.empty((len(x), tables, 1 + hashes), np.int64)
    for t in range(tables):
        best, second = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            a = size.argmax(axis=1)
            rows = np.arange(len(x))
            size[rows, a] = -1
            b = size.argmax(axis=1)
            best.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
        code = lambda picks: sum(p * (2 * d) ** k for k, p in enumerate(picks))
        out[:, t, 0] = code(best)
        for k in range(hashes):
            out[:, t, 1 + k] = code([second[k] if j == k else best[j] for j in range(hashes)])
    return out


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bucket codes to (node, weight, label, vector, hashes); leaves out what can't be compared."""
    for batch in short(batches):
        node, weight, label, vector, hashes = batch.columns
        lengths, joined = np.asarray(vector.value_lengths().fill_null(0)), hashes.to_numpy()
        for dim, k in sorted({(int(d), int(h)) for d, h in zip(lengths, joined, strict=True) if d > 0}):
            ix = np.flatnonzero((lengths == dim) & (joined == k))
            part = vector.take(pa.array(ix))
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                peak = np.abs(x).max(axis=1, keepdims=True)
                x = x / peak
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            ok = np.isfinite(x).all(axis=1) & np.isfinite(peak[:, 0]) & (peak[:, 0] > 0)
            ix, x = ix[ok], x[ok]
            if len(ix):
                codes = bucket_codes(x, k)
                take = lambda c, ix=ix: c.take(pa.array(ix))
                yield pa.RecordBatch.from_arrays([take(node), take(weight), take(label), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.full(len(ix), dim, np.int32)), take(hashes), pa.array(codes.reshape(len(ix), -1).tolist(), pa.list_(pa.int64()))], ["node", "weight", "label", "unit", "dim", "hashes", "codes"])


def _near_pairs(x: np.ndarray, block: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a bucket whose cosine reaches the threshold. one: whether a bucket's part is a block by itself, or pairs lie across two."""
    found = []
    for m in np.unique(sizes).tolist():
        u, v = np.triu_indices(m, 1)
        at = np.flatnonzero(sizes == m)
        for k in range(0, len(at), max(1, PAIRS // max(1, len(u)))):
            some = at[k : k + max(1, PAIRS // max(1, len(u)))]
            if m > 64:  # few buckets, many pairs each
                for s, alone in zip(starts[some].tolist(), one[some].tolist(), strict=True):
                    a, b = np.nonzero(np.triu(x[s : s + m] @ x[s : s + m].T >= threshold, 1))
                    a, b = a + s, b + s
                    keep = np.ones(len(a), bool) if alone else block[a] != block[b]
                    found.append((a[keep], b[keep]))
                continue
            a, b = (starts[some][:, None] + u).ravel(), (starts[some][:, None] + v).ravel()
            keep = np.repeat(one[some], len(u)) | (block[a] != block[b])
            a, b = a[keep], b[keep]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            found.append((a[near], b[near]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *side]).astype(np.int64) for side in zip(*found, strict=True)) if found else (none, none)


_GAINS = pa.schema([("node", pa.int64()), ("gain", pa.int64()), ("low", pa.int64())])


def _block_links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """Links within parts of buckets: how many each node gains, and spanning links."""
        out = [_GAINS.empty_table()]
        shape = list(zip(group.column("dim").to_pylist(), group.column("hashes").to_pylist(), strict=True))
        for dim, hashes in sorted(set(shape)):
            rows = group.take(pa.array([k for k, s in enumerate(shape) if s == (dim, hashes)])).sort_by([(c, "ascending") for c in ("label", "t", "code", "i", "j", "node")])
            node, weight, t, code, i, j, block = (rows.column(c).to_numpy() for c in ("node", "weight", "t", "code", "i", "j", "block"))
            label = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
            codes = np.array(rows.column("codes").to_pylist(), np.int64).reshape(len(node), -1, 1 + hashes)
            x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(node), dim)
            new = np.zeros(len(node), bool)
            new[0] = True
            for c in (label, t, code, i, j):
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            a, b = _near_pairs(x, block, starts, np.diff(np.append(starts, len(node))), (i == j)[starts], threshold)
            earlier = np.zeros(len(a), bool)
            for t0 in range(codes.shape[1]):
                meet = codes[a, t0][:, :, None] == codes[b, t0][:, None, :]
                earlier |= (t0 < t[a]) & meet.any(axis=(1, 2))
                earlier |= (t0 == t[a]) & (meet & (codes[a, t0][:, :, None] < code[a][:, None, None])).any(axis=(1, 2))
            a, b = a[~earlier], b[~earlier]
            gain = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
            hit = np.flatnonzero(gain)
            at, low = spanning(node, a, b)
            out.append(pa.table([pa.array(node[hit]), pa.array(gain[hit].astype(np.int64)), pa.nulls(len(hit), pa.int64())], schema=_GAINS))
            out.append(pa.table([pa.array(at), pa.array(np.zeros(len(at), np.int64)), pa.array(low)], schema=_GAINS))
        return pa.concat_tables(out)

    return run


def spanning(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) of a forest that spans the links a-b, by repeated minima."""
    low = np.arange(len(node))
    rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
    best = rank.copy()
    while True:
        new = best.copy()
        np.minimum.at(new, a, best[b])
        np.minimum.at(new, b, best[a])
        if (new == best).all():
            break
        best = new
    by_rank = np.empty(len(node), np.int64)
    by_rank[rank] = low
    hit = np.flatnonzero(best != rank)
    return node[hit], node[by_rank[best[hit]]]


def embedding_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    bounded(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("same", F.when(usable, F.sha2(F.concat_ws("|", "label", F.to_json(F.struct("vector"))), 256)))
    nodes = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    counts = nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n")).select("label", "dim", hashes_of(F.col("n"), F.col("dim")).alias("hashes"))
    # A row for each label and length, small enough for Spark to broadcast where it is.
    hashed = nodes.select("node", "weight", "label", "vector", F.size("vector").alias("dim")).join(staged(counts, "vector-hashes"), ["label", "dim"]).select("node", "weight", "label", "vector", "hashes")
    coded = staged(hashed.mapInArrow(_codes, "node bigint, weight bigint, label string, unit binary, dim int, hashes int, codes array<bigint>"), "vector-codes")
    entries = coded.select("node", "label", "dim", "hashes", F.posexplode("codes").alias("at", "code")).select("node", "label", "dim", F.expr("at div (1 + hashes)").cast("int").alias("t"), "code")
    key = ["t", "code", "label", "dim"]
    sizes = staged(entries.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")), "vector-buckets")
    dealt = entries.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select(*key, "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(*key, "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Parts of buckets are dealt to calls of some CALL_ROWS rows each; a part has two blocks at most.
    calls = 1 + (sizes.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0) // CALL_ROWS
    shipped = dealt.join(coded.select("node", "weight", "unit", "hashes", "codes"), "node").withColumn("call", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(calls)))
    gains = staged(shipped.groupBy("call").applyInArrow(_block_links(threshold), "node bigint, gain bigint, low bigint"), "vector-links")
    roots = components(gains.select(F.col("node").alias("a"), F.col("low").alias("b")))
    total = gains.groupBy("node").agg(F.sum("gain").alias("gain"))
    per_node = nodes.select("same", "node", "weight").join(total, "node", "left").join(roots, "node", "left").select("same", (F.coalesce("gain", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    return rows.select("vec_id", "same").join(per_node, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


#: Every pair of vectors of a label: fit for the small tables of the comparison only.
SQL = r"""WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
    c AS (SELECT vec_id AS node, vec_id AS dest FROM v UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.dest),
    root AS (SELECT node, min(dest) AS root FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(root.root, e.vec_id) AS component_id, coalesce(root.root, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN root ON root.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
