"""Connected components as a Spark job: alternating large-star and small-star rounds over an edge table.

Each round is two aggregations and two joins on node ids; hubs are met by partial aggregation and by skew
splitting in the joins. Lineage is cut each round by a checkpoint in the shared folder. Only a count and a
checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import shared_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), a > b. Large star: links larger neighbours to the smallest; small star: the smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), (F.least("a", "m") if large else F.col("m")).alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        out = joined.where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't the smallest of its component; root is that smallest node.

    Rounds go on until nothing changes, which takes some log of the number of nodes. Edges with a null end and loops are ignored. No edges: no rows.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("ok1"), F.col(b).isNotNull().alias("ok2")).where("ok1 and ok2 and a != b").select("a", "b").distinct().checkpoint()
    before = _state(edges)
    while before[0]:
        edges = _star(_star(edges, True), False).checkpoint()
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
