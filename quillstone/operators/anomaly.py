"""Unusual trading: before large moves, in unusual volume, in concentrated portfolios."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days after a trade between which its later price is looked for; days of the volume windows.
LATER = (28, 32)
LOOKBACK, BASELINE = 90, 365


def later_prices(trades: DataFrame, first: int = LATER[0], last: int = LATER[1]) -> DataFrame:
    """Adds the first price of the same ticker from `first` to `last` days later.

    Prices are reduced to one for each ticker and day, each is sent to the few days it may serve, and the
    rest is an equality join: no range is compared.
    """
    daily = trades.where("price is not null and ticker is not null").groupBy("ticker", "tx_date").agg(F.min_by("price", "tx_id").alias("later_price"))
    served = daily.select("ticker", "later_price", F.col("tx_date").alias("later_date"), F.explode(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda n: F.date_sub("tx_date", n))).alias("tx_date"))
    nearest = served.groupBy("ticker", "tx_date").agg(F.min(F.struct("later_date", "later_price")).alias("p")).select("ticker", "tx_date", "p.later_date", "p.later_price")
    return trades.join(nearest, ["ticker", "tx_date"], "left")


def pre_move_signals(trades: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Trades whose ticker moved by more than the threshold (percent) afterwards, and in which direction; any type but buy counts as a sell."""
    move = F.try_divide(F.col("later_price") - F.col("price"), F.col("price")) * 100
    rows = trades.where("price is not null and later_price is not null").withColumn("change_pct", move).where(F.abs("change_pct") > threshold)
    side = F.when(F.col("tx_type") == "buy", "buy").otherwise("sell")
    return rows.withColumn("direction", F.concat(side, F.when(F.col("change_pct") > 0, "_before_rise").otherwise("_before_drop")))


def volume_signals(trades: DataFrame, as_of: str | dt.date, key: str = "politician_id", lookback: int = LOOKBACK, baseline: int = BASELINE, unusual: float = 2.0) -> DataFrame:
    """Trades in the last `lookback` days against their usual number over the `baseline` days before; ratio 0 without a baseline."""
    day = F.lit(as_of).cast("date")
    start, before = F.date_sub(day, lookback), F.date_sub(day, lookback + baseline)
    date = F.col("tx_date")
    out = trades.groupBy(key).agg(F.count_if((date >= start) & (date <= day)).alias("recent"), F.count_if((date >= before) & (date < start)).alias("baseline"))
    usual = F.col("baseline") / F.lit(baseline / lookback)
    out = out.withColumn("usual", usual).withColumn("ratio", F.when(usual > 0, F.col("recent") / usual).otherwise(0.0))
    return out.withColumn("unusual", F.col("ratio") > unusual)


def sector_concentration(values: DataFrame, concentrated: float = 0.25) -> DataFrame:
    """Herfindahl index of each politician's portfolio by sector; rows without a sector or a positive value don't count.

    values: (politician_id, gics_sector, value).
    """
    sums = values.where("gics_sector is not null and value > 0").groupBy("politician_id", "gics_sector").agg(F.sum("value").alias("v"))
    share = sums.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("politician_id")))
    out = share.groupBy("politician_id").agg(F.sum(F.pow("w", F.lit(2))).alias("hhi"), F.max_by("gics_sector", F.struct("w", "gics_sector")).alias("dominant_sector"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gics_sector", F.col("w") * 100)))).alias("weights"))
    return out.withColumn("concentrated", F.col("hhi") > concentrated)


def composite_scores(pre_moves: DataFrame, volumes: DataFrame, hhi: DataFrame, least_score: float = 0.0, least_confidence: float = 0.0) -> DataFrame:
    """Everyone that any of the three knows, with the mean of the three parts, each capped at 1, and the share of parts that aren't 0.

    pre_moves: (politician_id, pre_moves); volumes: (politician_id, ratio); hhi: (politician_id, hhi). Each has a row for a politician at most and is read once; a null politician_id stands for no one's parts.
    """
    known = F.col("politician_id").isNotNull()
    every = [df.select("politician_id", F.when(known, F.col(c)).alias(c)) for df, c in ((pre_moves, "pre_moves"), (volumes, "ratio"), (hhi, "hhi"))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every).groupBy("politician_id").agg(*[F.max(c).alias(c) for c in ("pre_moves", "ratio", "hhi")]).fillna(0, ["pre_moves", "ratio", "hhi"])
    parts = [F.least(F.lit(1.0), F.col(c) / n) for c, n in (("pre_moves", 10.0), ("ratio", 5.0), ("hhi", 1.0))]
    out = rows.withColumn("score", (parts[0] + parts[1] + parts[2]) / 3)
    confidence = sum((F.col(c) > 0).cast("int") for c in ("pre_moves", "ratio", "hhi")) / F.lit(3.0)
    return out.withColumn("confidence", confidence).where((F.col("score") >= least_score) & (F.col("confidence") >= least_confidence))
