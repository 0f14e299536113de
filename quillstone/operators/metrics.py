"""Returns, benchmark alphas and rankings of closed lots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.filters import PoliticianFilter, period_start


def absolute_return(buy: str | Column, sell: str | Column) -> Column:
    """Percent; null where the buy price is 0."""
    buy = F.col(buy) if isinstance(buy, str) else buy
    sell = F.col(sell) if isinstance(sell, str) else sell
    return F.try_divide(sell - buy, buy) * 100


def annualized_return(percent: Column, days: Column) -> Column:
    """Null under 30 days."""
    return F.when(days >= 30, (F.pow(1 + percent / 100, F.lit(365.0) / days) - 1) * 100)


def trade_metrics(lots: DataFrame) -> DataFrame:
    """Adds return_pct, holding_days, annualized, alpha and benchmark_type (sector: both sides have a sector benchmark; spy: neither)."""
    priced = F.col("buy_benchmark").isNotNull() & F.col("sell_benchmark").isNotNull() & (F.col("buy_benchmark") > 1e-4)
    out = lots.withColumn("return_pct", absolute_return("buy_price", "sell_price")).withColumn("holding_days", F.datediff("sell_date", "buy_date").cast("bigint"))
    out = out.withColumn("annualized", annualized_return(F.col("return_pct"), F.col("holding_days")))
    out = out.withColumn("alpha", F.when(priced, F.col("return_pct") - absolute_return("buy_benchmark", "sell_benchmark")))
    kind = F.when(priced & F.col("buy_flag") & F.col("sell_flag"), "sector").when(priced & ~F.col("buy_flag") & ~F.col("sell_flag"), "spy")
    return out.withColumn("benchmark_type", kind)


def politician_metrics(metrics: DataFrame) -> DataFrame:
    """Per politician: lots, wins, rates and averages; holding days as a whole number of the average over lots that have one."""
    mean = lambda kind: F.avg(F.when(F.col("benchmark_type") == kind, F.col("alpha")))
    days = F.sum("holding_days"), F.count("holding_days")
    return metrics.groupBy("politician_id").agg(
        F.count("*").alias("total_trades"),
        F.count_if(F.col("return_pct") > 0).alias("win_count"),
        F.avg("return_pct").alias("avg_return"),
        mean("spy").alias("avg_alpha_spy"),
        mean("sector").alias("avg_alpha_sector"),
        F.when(days[1] > 0, F.floor(days[0] / days[1])).cast("bigint").alias("avg_holding_days"),
    ).withColumn("win_rate", F.col("win_count") / F.col("total_trades") * 100)


def with_percentile(df: DataFrame, by: str = "avg_return", tie: str = "politician_id", name: str = "percentile") -> DataFrame:
    """1.0 for the best down to 0.0; rows in a tie get values of their own, in order of `tie`; nulls come last.

    Rows are numbered within bands of the score, evenly wide on a logarithmic scale, and set off by the number
    of rows in better bands: no task holds more than a band, and only the bands' counts meet in one place.
    """
    # The inverse hyperbolic sine is logarithmic on both sides of 0; a null's band is beyond all others.
    banded = df.withColumn("_band", F.coalesce(-F.floor(F.asinh(F.col(by)) * 16), F.lit(1 << 40)))
    rows = banded.withColumn("_row", F.row_number().over(Window.partitionBy("_band").orderBy(F.col(by).desc_nulls_last(), tie)))
    every = Window.partitionBy(F.lit(1))
    sizes = banded.groupBy("_band").agg(F.count("*").alias("_c")).select(F.col("_band").alias("_b"), (F.sum("_c").over(every.orderBy("_band")) - F.col("_c")).alias("_before"), F.sum("_c").over(every).alias("_all"))
    place = F.col("_before") + F.col("_row") - 1
    out = rows.join(sizes, F.col("_band") == F.col("_b")).withColumn(name, F.when(F.col("_all") > 1, 1 - place / (F.col("_all") - 1)).otherwise(1.0))
    return out.drop("_band", "_row", "_b", "_before", "_all")


SORTS = {"return": lambda: F.col("avg_return"), "win-rate": lambda: F.col("win_rate"), "alpha": lambda: F.coalesce("avg_alpha_spy", "avg_alpha_sector")}


def leaderboard(lots: DataFrame, politicians: DataFrame, as_of: str | dt.date, period: str = "all", min_trades: int = 1, who: PoliticianFilter | None = None, sort: str = "return", top: int = 25) -> DataFrame:
    """Ranks politicians by their closed lots: period by sell date, then filters, then percentiles among those left, then the top."""
    start = period_start(period, as_of)
    metrics = trade_metrics(lots if start is None else lots.where(F.col("sell_date") >= start))
    people = politicians.where((who or PoliticianFilter()).predicate()).select("politician_id", "full_name", "party", "state")
    ranked = with_percentile(politician_metrics(metrics).where(F.col("total_trades") >= min_trades).join(people, "politician_id"))
    first = ranked.orderBy(SORTS[sort]().desc_nulls_last(), "politician_id").limit(top)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(SORTS[sort]().desc_nulls_last(), "politician_id"))
    return first.withColumn("rank", place.cast("bigint"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """For each politician and ticker the metrics of the lot closed last."""
    cols = ["return_pct", "holding_days", "annualized", "alpha", "benchmark_type"]
    last = F.max_by(F.struct(*cols), F.struct("sell_date", "sell_tx_id", "buy_date", "buy_tx_id"))
    return metrics.groupBy("politician_id", "ticker").agg(last.alias("m")).select("politician_id", "ticker", "m.*")


def trades_with_metrics(trades: DataFrame, metrics: DataFrame) -> DataFrame:
    """All trades; sells carry the latest metrics of their politician and ticker."""
    latest = latest_metrics(metrics).withColumn("tx_type", F.lit("sell"))
    return trades.join(latest, ["politician_id", "ticker", "tx_type"], "left")


def politicians_with_metrics(politicians: DataFrame, metrics: DataFrame) -> DataFrame:
    ranked = with_percentile(politician_metrics(metrics)).withColumn("percentile", F.col("percentile") * 100)
    return politicians.join(ranked, "politician_id", "left")
