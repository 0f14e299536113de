"""Statistics of trades kept as states that a run adds to, so that no run counts all trades again.

The state of a key has sums, the latest day, and a sketch of its distinct partners; exact distinct partners are a
table of pairs. States add up in any order, and a state of no trades changes nothing. Only new trades may be
added: a trade that a run merges into a stored one is no increment. Null volumes count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch's size: some 2 % off at 12.
SKETCH_BITS = 12


def state(trades: DataFrame, key: str, other: str) -> DataFrame:
    """(key, count_trades, volume, date_last, partners) of some trades; partners is a sketch."""
    return trades.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("count_trades"), F.coalesce(F.sum(F.col("value").cast("decimal(28, 2)")), F.lit(0)).cast("decimal(38, 2)").alias("volume"), F.max("tx_date").alias("date_last"), F.hll_sketch_agg(F.col(other), F.lit(SKETCH_BITS)).alias("partners"))


def added(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The state of the trades of both."""
    return one.unionByName(two).groupBy(key).agg(F.sum("count_trades").alias("count_trades"), F.sum("volume").cast("decimal(38, 2)").alias("volume"), F.max("date_last").alias("date_last"), F.hll_union_agg("partners").alias("partners"))


def pairs(trades: DataFrame, key: str, other: str) -> DataFrame:
    return trades.where(F.col(key).isNotNull() & F.col(other).isNotNull()).select(key, other).distinct()


def added_pairs(known: DataFrame, some: DataFrame) -> DataFrame:
    """Known pairs and those that are new; only new ones are written where buckets follow from the key."""
    return known.unionByName(some.join(known, some.columns, "left_anti").select(*known.columns))


def told(states: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, count_trades, volume, date_last, count_partners, about_partners): partners counted exactly by their pairs, and by the sketch alone."""
    exact = known.groupBy(key).agg(F.count("*").alias("count_partners"))
    return states.join(exact, key, "left").select(key, "count_trades", F.col("volume").cast("double").alias("volume"), "date_last", F.coalesce("count_partners", F.lit(0)).alias("count_partners"), F.hll_sketch_estimate("partners").alias("about_partners"))
