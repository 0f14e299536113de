"""Reads of trades, politicians and issuers with their filters, sorts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.filters import IssuerFilter, PoliticianFilter, TradeFilter


def joined_trades(trades: DataFrame, politicians: DataFrame, issuers: DataFrame, committees: DataFrame | None = None) -> DataFrame:
    """Trades with their politician and issuer; committees are gathered to an array first, so nothing multiplies."""
    people = politicians.select("politician_id", "first_name", "last_name", "full_name", "state", "party", "chamber", "gender")
    names = issuers.select("issuer_id", "issuer_name", "gics_sector", "sector", F.col("state").alias("issuer_state"), "country")
    out = trades.join(people, "politician_id").join(names, "issuer_id")
    if committees is not None:
        lists = committees.groupBy("politician_id").agg(F.array_sort(F.collect_set("committee")).alias("committees"))
        out = out.join(lists, "politician_id", "left")
    return out


TRADE_SORTS = {"pub-date": "pub_date", "trade-date": "tx_date", "reporting-gap": "reporting_gap"}


def query_trades(joined: DataFrame, spec: TradeFilter, sort: str = "pub-date", ascending: bool = False, limit: int | None = 12) -> DataFrame:
    rows = joined.withColumn("reporting_gap", F.datediff("pub_date", "tx_date")).where(spec.predicate())
    by = F.col(TRADE_SORTS[sort])
    rows = rows.orderBy(by.asc_nulls_first() if ascending else by.desc_nulls_last(), "tx_id")
    return rows.limit(limit) if limit else rows


def trade_stats(trades: DataFrame, key: str, other: str) -> DataFrame:
    """Over the whole table: count, distinct others, volume and last date for each key."""
    return trades.groupBy(key).agg(F.count("*").alias("count_trades"), F.count_distinct(other).alias(f"count_{other.removesuffix('_id')}s"), F.sum("value").alias("volume"), F.max("tx_date").alias("date_last_traded"))


POLITICIAN_SORTS = {
    "volume": ("volume", True), "name": ("last_name", False), "issuers": ("count_issuers", True), "trades": ("count_trades", True), "last-traded": ("date_last_traded", True)}
ISSUER_SORTS = {"volume": ("volume", True), "politicians": ("count_politicians", True), "trades": ("count_trades", True), "last-traded": ("date_last_traded", True)}


def _sorted(df: DataFrame, how: tuple[str, bool], tie: str, limit: int | None) -> DataFrame:
    by: Column = F.col(how[0]).desc_nulls_last() if how[1] else F.col(how[0]).asc_nulls_first()
    df = df.orderBy(by, tie)
    return df.limit(limit) if limit else df


def query_politicians(politicians: DataFrame, stats: DataFrame, committees: DataFrame, spec: PoliticianFilter, sort: str = "volume", limit: int | None = None) -> DataFrame:
    lists = committees.groupBy("politician_id").agg(F.array_sort(F.collect_set("committee")).alias("committees"))
    rows = politicians.where(spec.predicate()).join(stats, "politician_id", "left").join(lists, "politician_id", "left")
    return _sorted(rows, POLITICIAN_SORTS[sort], "politician_id", limit)


def query_issuers(issuers: DataFrame, stats: DataFrame, spec: IssuerFilter, performance: DataFrame | None = None, sort: str = "volume", limit: int | None = None) -> DataFrame:
    rows = issuers.where(spec.predicate()).join(stats, "issuer_id", "left")
    if performance is not None:
        rows = rows.join(performance, "issuer_id", "left")
    return _sorted(rows, ISSUER_SORTS[sort], "issuer_id", limit)


def top_traded_tickers(trades: DataFrame, limit: int) -> DataFrame:
    return trades.where("ticker is not null and ticker != ''").groupBy("ticker").agg(F.count("*").alias("count_trades")).orderBy(F.desc("count_trades"), "ticker").limit(limit)


def trades_by_month(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.date_format("tx_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("count_trades"), F.sum("value").alias("volume"))


def volume_by(joined: DataFrame, key: str) -> DataFrame:
    return joined.groupBy(key).agg(F.count("*").alias("count_trades"), F.sum("value").alias("volume"))


def trades_grouped(trades: DataFrame, key: str) -> DataFrame:
    """Each key's trades as a sorted array of structs. An array is as long as its group: for reports, not for joins."""
    return trades.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tx_id", "tx_date", "tx_type", "value"))).alias("trades"))


def rollup_volume(joined: DataFrame, *keys: str) -> DataFrame:
    """Extra: volume over every prefix of the keys, with the grouping level."""
    return joined.rollup(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("count_trades"), F.sum("value").alias("volume"))


def point(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns have these values; None matches null."""
    out = df
    for k, v in keys.items():
        out = out.where(F.col(k).eqNullSafe(F.lit(v)))
    return out


def high_water_mark(trades: DataFrame) -> DataFrame:
    return trades.agg(F.count("*").alias("count_trades"), F.max(F.to_date("pub_date")).alias("max_pub_date"))


def newest_per(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in by])
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
