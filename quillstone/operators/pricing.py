"""Price enrichment: as-of prices, benchmarks, work queues and diagnostics."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import estimated_shares, exchange_suffix, percent_of, price_ticker


def as_of_prices(wanted: DataFrame, prices: DataFrame, days: int = 7, key: str = "ticker", day: str = "tx_date") -> DataFrame:
    """Adds the last price of the key on the day or up to `days` days before, and its date.

    The distinct (key, day) pairs are looked up once and joined back. A price is sent to the few days it may
    serve, so the lookup is an equality join.
    """
    pairs = wanted.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, day).distinct()
    served = prices.where("price is not null").select(F.col("ticker").alias(key), F.col("price_date"), F.col("price").alias("_price"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda n: F.date_add("price_date", n))).alias(day))
    found = pairs.join(served, [key, day]).groupBy(key, day).agg(F.max(F.struct("price_date", "_price")).alias("p"))
    return wanted.join(found.select(key, day, F.col("p._price").alias("asof_price"), F.col("p.price_date").alias("asof_date")), [key, day], "left")


def current_prices(tickers: DataFrame, prices: DataFrame, as_of: str | dt.date, days: int = 7) -> DataFrame:
    return as_of_prices(tickers.withColumn("_day", F.lit(as_of).cast("date")), prices, days, day="_day").drop("_day")


def first_of(wanted: DataFrame, sources: list[DataFrame], days: int = 7) -> DataFrame:
    """As-of prices from several sources, the first that has one."""
    out = wanted
    for i, prices in enumerate(sources):
        out = as_of_prices(out, prices, days).withColumnsRenamed({"asof_price": f"_p{i}", "asof_date": f"_d{i}"})
    return out.withColumn("asof_price", F.coalesce(*[f"_p{i}" for i in range(len(sources))])).drop(*[f"_{c}{i}" for i in range(len(sources)) for c in "pd"])


def benchmarks(trades: DataFrame, issuers: DataFrame, sector_benchmarks: DataFrame, default: str = "SPY") -> DataFrame:
    """Adds the fund that a trade is measured against: its sector's, else the default."""
    funds = sector_benchmarks.where("sector is not null").select(F.col("sector").alias("gics_sector"), "etf")
    return trades.join(issuers.select("issuer_id", "gics_sector"), "issuer_id", "left").join(funds, "gics_sector", "left").withColumn("benchmark", F.coalesce("etf", F.lit(default))).drop("etf")


def needs_price() -> Column:
    return F.col("ticker").isNotNull() & (F.col("ticker") != "") & F.col("tx_date").isNotNull() & F.col("price_enriched_at").isNull()


def needs_benchmark() -> Column:
    return F.col("tx_date").isNotNull() & F.col("benchmark_price").isNull() & F.col("ticker").isNotNull() & (F.col("ticker") != "")


def queue(rows: DataFrame, condition: Column, key: str, limit: int | None = None) -> DataFrame:
    out = rows.where(condition).orderBy(key)
    return out.limit(limit) if limit else out


def _reason() -> Column:
    return F.when(F.col("ticker").isNull() | (F.col("ticker") == ""), "no ticker").when(F.col("tx_date").isNull(), "no date").otherwise("no price found")


def diagnostics(trades: DataFrame) -> dict[str, DataFrame]:
    """What enrichment reached: totals, reasons of failure, the tickers that failed most, suffixes and sources."""
    tried, priced = F.col("price_enriched_at").isNotNull(), F.col("price").isNotNull() & F.col("current_price").isNotNull()
    failed = trades.where(tried & F.col("current_price").isNull())
    totals = trades.agg(F.count("*").alias("total"), F.count_if(tried).alias("tried"), F.count_if(priced & tried).alias("priced"), F.count_if(tried & F.col("current_price").isNull()).alias("failed"))
    return {
        "totals": totals.withColumn("priced_pct", percent_of("priced", "total")),
        "reasons": failed.groupBy(_reason().alias("reason")).agg(F.count("*").alias("n")),
        "tickers": failed.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(30),
        "suffixes": failed.groupBy(exchange_suffix("ticker").alias("suffix")).agg(F.count("*").alias("n")),
        "asset_types": trades.where(tried).groupBy("asset_type").agg(F.count("*").alias("n"), F.count("current_price").alias("priced")),
    }


def report(trades: DataFrame) -> DataFrame:
    """The diagnostics as one table (section, item, n, pct): reasons and tickers as shares of what failed, kinds of assets as shares priced of what was tried; null where there is nothing to be a share of.

    Trades are read once: all sections follow from counts by kind of asset, ticker and reason.
    """
    tried, priced, known = F.col("price_enriched_at").isNotNull(), F.col("price").isNotNull(), F.col("current_price").isNotNull()
    counts = {"total": F.count("*"), "tried": F.count_if(tried), "priced": F.count_if(tried & priced & known), "failed": F.count_if(tried & ~known), "known": F.count_if(tried & known)}
    cells = trades.groupBy("asset_type", "ticker", _reason().alias("reason")).agg(*[n.alias(c) for c, n in counts.items()])
    part = lambda section, item, n, of: F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), n.alias("n"), of.alias("of"))
    items = [c for c in counts if c != "known"]
    parts = [part("trades", F.lit(c), F.col(c), F.col("total")) for c in items] + [part("priced of tried", F.col("asset_type"), F.col("known"), F.col("tried"))]
    rows = cells.select(F.explode(F.array(*parts, *[part(k, F.col(c), F.col("failed"), F.col("failed")) for k, c in (("reasons", "reason"), ("tickers", "ticker"))])).alias("r")).select("r.*")
    # Of no trades there are counts as well.
    none = trades.sparkSession.range(1).select(F.explode(F.array(*[part("trades", F.lit(c), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")) for c in items])).alias("r")).select("r.*")
    sums = rows.unionByName(none).groupBy("section", "item").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).where((F.col("of") > 0) | (F.col("section") == "trades"))
    of_failed = F.col("section").isin("reasons", "tickers")
    every = Window.partitionBy("section")
    sums = sums.withColumns({"of": F.when(of_failed, F.sum("n").over(every)).otherwise(F.col("of")), "place": F.row_number().over(every.orderBy(F.desc("n"), F.asc_nulls_last("item")))})
    item = F.when(of_failed, F.coalesce("item", F.lit(""))).otherwise(F.col("item"))
    return sums.where((F.col("section") != "tickers") | (F.col("place") <= 30)).select("section", item.alias("item"), "n", F.when(F.col("of") > 0, F.round(100 * F.col("n") / F.col("of"), 4)).alias("pct"))


def unenriched(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, n, first_id): rows of each table that were never enriched, and the smallest id among them. tables: rows and the name of their key."""
    parts = [rows.where("enriched_at is null").agg(F.count("*").alias("n"), F.min(key).cast("string").alias("first_id")).select(F.lit(name).alias("table"), "n", "first_id") for name, (rows, key) in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def reset_failed(trades: DataFrame) -> DataFrame:
    """Trades with failed enrichments open again."""
    return trades.withColumn("price_enriched_at", F.when(F.col("current_price").isNotNull(), F.col("price_enriched_at")))


def resolved_tickers(trades: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds the price source's ticker: an alias of the raw or the trimmed ticker holds, even an alias to nothing; else the rule. aliases: (raw, alias)."""
    known = aliases.select(F.trim("raw").alias("_raw"), "alias", F.lit(True).alias("_known")).dropDuplicates(["_raw"])
    return trades.join(known, F.trim("ticker") == F.col("_raw"), "left").withColumn("price_ticker", F.when(F.col("_known"), F.col("alias")).otherwise(price_ticker("ticker"))).drop("_raw", "alias", "_known")


def enriched(trades: DataFrame, issuers: DataFrame, sector_benchmarks: DataFrame, prices: DataFrame, fund_prices: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The three phases as one job: the price on the day, the price now, the benchmark's price; and shares from them."""
    rows = as_of_prices(trades, prices).withColumnsRenamed({"asof_price": "trade_date_price", "asof_date": "trade_price_date"})
    now = current_prices(trades.select("ticker").distinct(), prices, as_of).select("ticker", F.col("asof_price").alias("price_now"))
    rows = benchmarks(rows.join(now, "ticker", "left"), issuers, sector_benchmarks)
    rows = as_of_prices(rows, fund_prices.withColumnRenamed("benchmark", "ticker") if "benchmark" in fund_prices.columns else fund_prices, key="benchmark").withColumnRenamed("asof_price", "fund_price").drop("asof_date")
    return rows.withColumn("estimated_shares", estimated_shares("size_range_low", "size_range_high", "value", "trade_date_price"))
