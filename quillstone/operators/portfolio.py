"""Positions with current prices, unrealised profit, sectors and committee flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_prices(trades: DataFrame) -> DataFrame:
    """The current price of the trade priced last, for each ticker: one aggregation instead of a lookup for each row."""
    priced = trades.where(F.col("current_price").isNotNull() & F.col("price_enriched_at").isNotNull())
    return priced.groupBy("ticker").agg(F.max_by("current_price", F.struct("price_enriched_at", "tx_id")).alias("current_price"))


def valued(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds current_price, current_value, unrealized_pnl and its percentage (0 where the cost basis is); null without a price."""
    out = positions.join(prices, "ticker", "left").withColumn("current_value", F.col("shares_held") * F.col("current_price"))
    gain = (F.col("current_price") - F.col("cost_basis")) * F.col("shares_held")
    percent = F.when(F.col("current_price").isNull(), None).when(F.col("cost_basis") > 1e-4, (F.col("current_price") - F.col("cost_basis")) / F.col("cost_basis") * 100).otherwise(0.0)
    return out.withColumn("unrealized_pnl", gain).withColumn("unrealized_pct", percent)


def with_conflict_flags(positions: DataFrame, issuers: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds the sector of the ticker and whether a committee of the politician oversees it; null where the sector is. sectors: (politician_id, sectors)."""
    out = positions.join(issuers.select("ticker", "gics_sector"), "ticker", "left").join(sectors, "politician_id", "left")
    flag = F.when(F.col("gics_sector").isNotNull(), F.coalesce(F.array_contains("sectors", F.col("gics_sector")), F.lit(False)))
    return out.withColumn("in_committee_sector", flag).drop("sectors")


def option_count(trades: DataFrame, politician_id: str | None = None) -> DataFrame:
    rows = trades.where(F.col("asset_type") == "stock-option")
    return (rows.where(F.col("politician_id") == politician_id) if politician_id else rows).agg(F.count("*").alias("count_options"))
