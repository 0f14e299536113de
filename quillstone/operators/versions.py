"""Stored tables brought from any earlier version to the newest, one step after the other.

A step adds columns that a table lacks (as nulls), creates tables that aren't there (empty), or fills what earlier
versions left empty. Steps are idempotent: what a table already has stays. The version stands in the table meta
as schema_version; tables without meta are of version 0. At the end sector mappings are applied, as they are
whenever tables are built, and the meta row is brought up to date. Columns beyond the schema stay behind those it names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import schemas as S
from quillstone.operators import merge
from quillstone.sources.adapters import SECTORS

Tables = dict[str, DataFrame]


def _adds(table: str, columns: str) -> Callable[[SparkSession, Tables], Tables]:
    def step(spark: SparkSession, tables: Tables) -> Tables:
        if table not in tables:
            return tables
        rows = tables[table]
        lacking = [f for f in S.schema(columns).fields if f.name not in rows.columns]
        return tables | {table: rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}) if lacking else rows}

    return step


def _creates(table: str, schema: str) -> Callable[[SparkSession, Tables], Tables]:
    return lambda spark, tables: tables if table in tables else tables | {table: spark.createDataFrame([], getattr(S, schema))}


def _changes(table: str, change: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, Tables], Tables]:
    return lambda spark, tables: tables | {table: change(tables[table])} if table in tables else tables


def _cycles(cursors: DataFrame) -> DataFrame:
    """Cursors by politician, committee and cycle; those of before cycles have none. Of several with a key the one furthest on stays."""
    rows = cursors if "cycle" in cursors.columns else cursors.withColumn("cycle", F.lit(None).cast("int"))
    return merge.last_of(rows, merge.CURSOR_KEYS, ["total_synced", "last_index"])


def _shares(trades: DataFrame) -> DataFrame:
    """Shares by value where the range gave none, and the value that they stand for."""
    if not {"trade_date_price", "estimated_shares", "value"} <= set(trades.columns):
        return trades
    none = F.col("estimated_shares").isNull() & (F.col("trade_date_price") > 0) & (F.col("value") > 0)
    rows = trades.withColumn("estimated_value", F.when(none, F.col("value").cast("double")).otherwise(F.col("estimated_value"))) if "estimated_value" in trades.columns else trades
    return merge.backfill_shares(rows)


#: Steps by the version that they lead to.
STEPS: dict[int, tuple] = {
    1: tuple(_adds(t, "enriched_at timestamp") for t in ("trades", "politicians", "issuers")),
    2: (_adds("trades", "trade_date_price double, current_price double, price_enriched_at timestamp, estimated_shares double, estimated_value double"),),
    3: (_creates("fec_mappings", "FEC_MAPPINGS"),),
    4: (_creates("fec_committees", "FEC_COMMITTEES"), _creates("donations", "DONATIONS"), _creates("donation_sync", "DONATION_SYNC"), _adds("fec_mappings", "committee_ids array<string>")),
    5: (_creates("employer_mappings", "EMPLOYER_MAPPINGS"), _creates("employer_lookup", "EMPLOYER_LOOKUP")),
    6: (_adds("issuers", "gics_sector string"), _creates("sector_benchmarks", "SECTOR_BENCHMARKS")),
    7: (_adds("trades", "benchmark_price double"),),
    8: (_changes("donation_sync", _cycles),),
    9: (_adds("trades", "price_source string"), _changes("trades", lambda t: merge.backfill_source(t) if "trade_date_price" in t.columns else t)),
    10: (_changes("trades", _shares),),
}
LATEST = max(STEPS)


def version_of(tables: Tables) -> int:
    if "meta" not in tables:
        return 0
    found = tables["meta"].where("key = 'schema_version'").agg(F.max(F.col("value").cast("int"))).first()[0]
    return found or 0


def migrated(spark: SparkSession, tables: Tables, to: int = LATEST, sectors: DataFrame | None = None) -> Tables:
    """The tables at a version. sectors: (ticker, sector), applied to issuers at the newest one."""
    begin = version_of(tables)
    if begin > to:
        raise ValueError(f"tables of version {begin} can't go back to {to}")
    for number in range(begin + 1, to + 1):
        for step in STEPS[number]:
            tables = step(spark, tables)
    if to == LATEST:
        if sectors is not None and "issuers" in tables:
            tables = tables | {"issuers": merge.apply_sectors(tables["issuers"], sectors)}
        known = spark.createDataFrame([(s, etf) for s, etf in SECTORS], "sector string, etf_ticker string").withColumn("etf_name", F.lit(None).cast("string"))
        tables = tables | {"sector_benchmarks": merge.upsert(tables["sector_benchmarks"], known, ["sector"], {"etf_name": merge.old})}
    stamp = spark.createDataFrame([("schema_version", str(to))], "key string, value string")
    return tables | {"meta": merge.upsert(tables["meta"], stamp, ["key"]) if "meta" in tables else stamp}
