"""Exact top-k search by inner product in M-trees.

With one more component sqrt(M^2 - |x|^2), M the largest length of all vectors, and none for queries, an inner
product becomes a distance: |q|^2 + M^2 - 2 q x, squared. So the greatest products are the nearest vectors of a
metric space, which M-trees search. Bounds are widened for rounding and inclusive, products are whole numbers;
the result is exact, ties included.

* Equal vectors are one entry with its k + 1 smallest ids, for no further copy can be among the first k; equal
  queries are searched once, for k + 1 rows, of which each leaves its own out.
* The upper level deals vectors to the nearest of at most PIVOTS vectors; regions of more than TREE vectors, however
  large, are split by hash. Each part becomes a tree in a task of its own: a table of pages, each with routing
  vectors, covering radii, distances to the parent and pages below, or with vectors and their distances to the parent.
* A query first searches one tree of its own region; its k-th distance then rules out regions by their
  covering radii. The trees left are searched in blocks of queries against trees, with that distance to begin with.
* A search takes pages from a queue by their least possible distance. Of a page's entries those are left out
  without a distance whose distance to the parent differs from the query's by more than radius and bound.

Vectors are compared with those of the same length. Vectors null or holding null or non-finite components, and rows
without an id, take no part; an empty vector has the product 0 with other empty ones. Rows repeated whole count
once; of rows that share an id but not a vector each is a query, and a candidate of the others. Extra columns are
ignored. An empty table gives no rows. Whole numbers beyond 2^27, or whose products don't fit a long, are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, short, staged, table

#: Vectors of the upper level for each length of vectors; vectors of a tree; entries of a page; queries of a block.
PIVOTS, TREE, PAGE, BLOCK = 256, 16_384, 96, 512
#: Bounds are widened by this share of the largest distance.
SLACK = 1e-9
LARGEST = 1 << 27


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """The component that turns products into distances; most: the largest squared length."""
    return np.sqrt(np.maximum(most - (x.astype(np.float64) ** 2).sum(1), 0.0))


def between(x: np.ndarray, hx: np.ndarray, y: np.ndarray, hy: float) -> np.ndarray:
    """Distances of vectors to one vector, lifted components apart."""
    d = x.astype(np.float64) - y
    return np.sqrt((d * d).sum(1) + (hx - hy) ** 2)


class Page:
    """entries: row numbers of vectors; below: a page's number for each, in inner pages; radius; parent: distances to the routing vector of the page."""

    __slots__ = ("entries", "below", "radius", "parent")

    def __init__(self, entries, below, radius, parent):
        self.entries, self.below, self.radius, self.parent = entries, below, radius, parent


def built(x: np.ndarray, most: float, page: int = PAGE) -> list[Page]:
    """The pages of a tree over the rows of x, the root first. Rows are dealt to routing vectors spread over them, again and again until they fit a page."""
    h = lifted(x, most)
    pages: list[Page] = []
    todo = [(np.arange(len(x)), -1, None)]  # rows, their routing vector, and the entry that leads to them
    while todo:
        rows, router, lead = todo.pop()
        number = len(pages)
        if lead is not None:
            lead[0].below[lead[1]] = number
        apart = lambda r, to: between(x[r], h[r], x[to], h[to]) if to >= 0 else np.zeros(len(r))
        if len(rows) <= page:
            pages.append(Page(rows, None, np.zeros(len(rows)), apart(rows, router)))
            continue
        picks = rows[np.linspace(0, len(rows) - 1, min(page, -(-len(rows) // page) * 2)).astype(np.int64)]
        best, at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for k, p in enumerate(picks):
            d = apart(rows, p)
            at[d < best], best = k, np.minimum(best, d)
        parts = [(picks[k], np.flatnonzero(at == k)) for k in np.unique(at)]
        if max(len(p) for _, p in parts) > 0.9 * len(rows):  # too alike to be dealt by distance: in equal parts
            parts = [(rows[p[0]], p) for p in np.array_split(np.argsort(best, kind="stable"), min(page, -(-len(rows) // page)))]
        routers = np.array([r for r, _ in parts])
        spread = [apart(rows[p], r) for r, p in parts]
        inner = Page(routers, np.zeros(len(parts), np.int64), np.array([s.max() for s in spread]), apart(routers, router))
        pages.append(inner)
        todo += [(rows[p], r, (inner, k)) for k, (r, p) in enumerate(parts)]
    return pages


class Tree:
    """Pages with their vectors at hand, and ids of each vector: (entry of ids, id)."""

    def __init__(self, pages: list[Page], x: np.ndarray, ids: list[list[int]], most: float):
        self.pages, self.x, self.ids, self.most = pages, x, ids, most
        self.vectors = [x[p.entries] for p in pages]
        self.distances = 0

    def search(self, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """At most k (product, id), the greatest first, then the smallest ids; none below floor. Copies of a vector count each."""
        length = int((q * q).sum())
        top = np.sqrt(length + self.most)
        slack = SLACK * 2 * max(top, 1.0)
        distance = lambda s: np.sqrt(np.maximum(length + self.most - 2.0 * s, 0.0))
        found: list[tuple[int, int]] = []  # a heap of (product, -id), the worst first
        bound = distance(float(floor)) + slack if floor is not None else np.inf
        queue = [(0.0, 0, -1.0)]  # least distance, page, distance of its routing vector
        while queue:
            least, number, up = heapq.heappop(queue)
            if least > bound:
                break
            page, x = self.pages[number], self.vectors[number]
            if up >= 0:
                near = np.flatnonzero(np.abs(up - page.parent) - page.radius <= bound)
                if not len(near):
                    continue
            else:
                near = np.arange(len(page.entries))
            products = x[near] @ q
            self.distances += len(near)
            if page.below is not None:
                d = distance(products)
                least_of = np.maximum(d - page.radius[near], 0.0) - slack
                for j in np.flatnonzero(least_of <= bound).tolist():
                    heapq.heappush(queue, (least_of[j], int(page.below[near[j]]), d[j]))
                continue
            lowest = found[0][0] if len(found) >= k else floor
            hits = np.flatnonzero(products >= lowest) if lowest is not None else np.arange(len(near))
            for j in hits[np.argsort(-products[hits], kind="stable")].tolist():
                s = int(products[j])
                for i in self.ids[page.entries[near[j]]]:
                    if len(found) < k:
                        heapq.heappush(found, (s, -i))
                    elif (s, -i) > found[0]:
                        heapq.heapreplace(found, (s, -i))
                    else:
                        break  # further ids are larger
            if len(found) >= k:
                bound = min(bound, distance(float(found[0][0])) + slack)
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def _regions(pivots: dict[int, np.ndarray], mosts: dict[int, float]):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            raw = batch.column("x").to_pylist()
            region, reach = np.zeros(len(raw), np.int32), np.zeros(len(raw))
            lengths = np.array([len(r) // 4 for r in raw], np.int64)
            for dim in np.unique(lengths).tolist():
                ix = np.flatnonzero(lengths == dim)
                x = np.frombuffer(b"".join(raw[i] for i in ix), np.int32).reshape(len(ix), dim).astype(np.float64)
                p, most = pivots[dim].astype(np.float64), mosts[dim]
                hx, hp = lifted(x, most), lifted(p, most)
                d = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T) + (hx[:, None] - hp) ** 2
                region[ix] = d.argmin(1)
                for k in np.unique(region[ix]).tolist():
                    own = ix[region[ix] == k]
                    reach[own] = between(x[np.isin(ix, own)], hx[np.isin(ix, own)], p[k], hp[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(region), pa.array(reach)], [*batch.schema.names, "dim", "region", "reach"])

    return run


_PAGE_SQL = "dim int, region int, part int, page int, ids array<array<bigint>>, x binary, below array<int>, radius array<double>, parent array<double>"


def _pages(mosts: dict[int, float]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        dim, region, part = (int(group[c].iloc[0]) for c in ("dim", "region", "part"))
        group = group.sort_values("node", kind="stable")
        x = np.frombuffer(b"".join(group["x"]), np.int32).reshape(len(group), dim)
        ids = [list(i) for i in group["ids"]]
        out = []
        for number, p in enumerate(built(x, mosts[dim])):
            leaf = p.below is None
            out.append((dim, region, part, number, [ids[e] for e in p.entries] if leaf else None, x[p.entries].tobytes(), None if leaf else p.below.tolist(), p.radius.tolist(), p.parent.tolist()))
        return pd.DataFrame(out, columns=["dim", "region", "part", "page", "ids", "x", "below", "radius", "parent"])

    return run


def _tree(pages: pd.DataFrame, dim: int, most: float) -> Tree:
    pages = pages.sort_values("page", kind="stable")
    made, vectors, ids, at = [], [], [], 0
    for below, radius, parent, raw, own in zip(pages["below"], pages["radius"], pages["parent"], pages["x"], pages["ids"], strict=True):
        x = np.frombuffer(raw, np.int32).reshape(len(radius), dim).astype(np.int64)
        made.append(Page(np.arange(at, at + len(x)), None if below is None else np.asarray(below), np.asarray(radius), np.asarray(parent)))
        vectors.append(x)
        ids += [[]] * len(x) if own is None else [list(i) for i in own]
        at += len(x)
    return Tree(made, np.concatenate(vectors), ids, most)


def _searched(mosts: dict[int, float], k: int):
    """Queries (node, x, floor) of a block in a tree: (node, hits), hits as (product, id)."""

    def run(key: tuple, queries: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(pages):
            dim = int(pages["dim"].iloc[0])
            tree = _tree(pages, dim, mosts[dim])
            for node, raw, floor in zip(queries["node"], queries["x"], queries["floor"], strict=True):
                hits = tree.search(np.frombuffer(raw, np.int32).astype(np.int64), k, None if pd.isna(floor) else int(floor))
                out += [(node, s, i) for s, i in hits]
        return pd.DataFrame(out, columns=["node", "score", "vec_id"])

    return run


def _left(pivots: dict[int, np.ndarray], mosts: dict[int, float], reaches: dict[tuple[int, int], float]):
    """(node, x, floor, region): for each query the regions that its floor doesn't rule out, its own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            take, regions = [], []
            for j, (dim, raw, floor) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("x").to_pylist(), batch.column("floor").to_pylist(), strict=True)):
                q, p, most = np.frombuffer(raw, np.int32).astype(np.float64), pivots[dim].astype(np.float64), mosts[dim]
                base = (q * q).sum() + most
                slack = SLACK * 2 * max(np.sqrt(base), 1.0)
                reach = np.array([reaches.get((dim, r), -1.0) for r in range(len(p))])
                least = np.sqrt(np.maximum(base - 2 * (p @ q), 0.0)) - reach - slack
                bound = np.inf if floor is None else np.sqrt(max(base - 2.0 * floor, 0.0)) + slack
                some = np.flatnonzero((reach >= 0) & (least <= bound))
                take += [j] * len(some)
                regions += some.tolist()
            ix = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(ix) for c in ("dim", "node", "x", "floor")), pa.array(regions, pa.int32())], ["dim", "node", "x", "floor", "region"])

    return run


def _blocks(queries: DataFrame) -> DataFrame:
    """Adds to (dim, region, part, node, ...) a block of at most about BLOCK queries of a tree, and the number of its blocks."""
    tree = ["dim", "region", "part"]
    sizes = queries.groupBy(*tree).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return queries.join(sizes, tree).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _hits(queries: DataFrame, pages: DataFrame, mosts: dict[int, float], k: int) -> DataFrame:
    """(node, score, vec_id): the best rows of each query in each tree that it is dealt to."""
    tree = ["dim", "region", "part"]
    dealt = staged(_blocks(queries), "tree-queries")
    wanted = pages.join(dealt.groupBy(*tree).agg(F.first("blocks").alias("blocks")), tree).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*tree, "block"]
    return dealt.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(_searched(mosts, k), "node bigint, score bigint, vec_id bigint")


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of the greatest products."""
    spark = vectors.sparkSession
    bounded(spark)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(column(id_col).cast("bigint").alias("vec_id"), column(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = F.transform("v", lambda c: F.floor(c * scale))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            raw, own = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.int64)
                if x.size and (np.abs(x).max() > LARGEST or x.size * float(np.abs(x).max()) ** 2 >= 2.0**62):
                    raise ValueError("whole numbers whose inner products don't fit a long")
                raw.append(x.astype(np.int32).tobytes())
                own.append(int((x * x).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(own, pa.int64())], ["vec_id", "x", "own"])

    rows = rows.select("vec_id", scaled.alias("v")).mapInArrow(packed, "vec_id bigint, x binary, own bigint").distinct()
    first = Window.partitionBy("x").orderBy("vec_id")
    # The k + 1 smallest ids of each vector; what a task holds more of goes before the shuffle.
    rows = staged(rows, "tree-rows")
    nodes = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("own").alias("own"))
    # Numbers that a written table keeps; rows may share an id, so ids don't serve.
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "tree-vectors")

    dim = F.expr("length(x) div 4").cast("int")
    # At most PIVOTS vectors of each length, by a hash of the vector: places to begin with, whatever the number of rows.
    hashed = Window.partitionBy("dim").orderBy(F.xxhash64("x"), "x")
    some = nodes.select(dim.alias("dim"), "x").withColumn("k", F.row_number().over(hashed)).where(F.col("k") <= PIVOTS).select("dim", "k", "x").orderBy("dim", "k").collect()
    pivots = {d: np.stack([np.frombuffer(r.x, np.int32) for r in some if r.dim == d]) for d in sorted({r.dim for r in some})}

    mosts = {r.dim: float(r.most) for r in nodes.groupBy(dim.alias("dim")).agg(F.max("own").alias("most")).collect()}
    placed = staged(nodes.select("node", "x", "ids").mapInArrow(_regions(pivots, mosts), "node bigint, x binary, ids array<bigint>, dim int, region int, reach double"), "tree-regions")
    # A row for each pivot: its vectors and its covering radius.
    sizes = placed.groupBy("dim", "region").agg(F.max("reach").alias("reach"), F.ceil(F.count("*") / TREE).cast("int").alias("parts"))
    of_region = sizes.collect()
    reaches = {(r.dim, r.region): r.reach * (1 + SLACK) for r in of_region}
    parts = F.broadcast(spark.createDataFrame([(r.dim, r.region, r.parts) for r in of_region], "dim int, region int, parts int"))
    dealt = placed.join(parts, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pages = staged(dealt.select("dim", "region", "part", "node", "x", "ids").groupBy("dim", "region", "part").applyInPandas(_pages(mosts), _PAGE_SQL), "tree-pages")

    # A vector is a query if any of its rows is, not only those among its first ids. Of rows that share an id each vector is a query.
    asked = rows.where(F.col("vec_id") % every == 0)
    query_nodes = asked.select("x").distinct().join(dealt.select("x", "node", "dim", "region", "part"), "x")
    home = _hits(query_nodes.withColumn("floor", F.lit(None).cast("bigint")), pages, mosts, k + 1)
    home = staged(home, "tree-home")
    worst = home.groupBy("node").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("node", F.when(F.col("n") > k, F.col("low")).alias("floor"))
    begun = query_nodes.join(worst, "node", "left").select("dim", "node", "x", "floor")
    left = begun.mapInArrow(_left(pivots, mosts, reaches), "dim int, node bigint, x binary, floor bigint, region int")
    spread = left.join(parts, ["dim", "region"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at_home = query_nodes.select("node", "dim", "region", "part")
    away = _hits(spread.select("dim", "region", "part", "node", "x", "floor").join(at_home, ["node", "dim", "region", "part"], "left_anti"), pages, mosts, k + 1)
    best = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    hits = home.unionByName(away).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("node").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("hits"))
    of_row = asked.join(nodes.select("x", "node"), "x").join(hits, "node").withColumn("hits", F.sort_array("hits"))
    # Its own row is the entry of its id and its own square, if that is among them.
    mine = F.array_position("hits", F.struct((-F.col("own")).alias("s"), "vec_id"))
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != mine), 1, k)
    out = of_row.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.s")).alias("score"))


def op13_metric_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


#: Every query against every row: fit for the small tables of the comparison only.
SQL = """WITH v AS MATERIALIZED (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])), 0) AS BIGINT) AS score
        FROM v q JOIN v ON (v.vec_id <> q.vec_id OR v.x <> q.x) AND len(v.x) = len(q.x) WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
