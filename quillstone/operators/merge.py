"""Merges of incoming rows into stored tables, as full outer joins with a rule for each column.

Plain Parquet has no row-level update: each function returns the new state of the table, to be written in
place of the old one. Incoming rows are first reduced to the last for each key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column, Column], Column]


def new(n: Column, o: Column, there: Column) -> Column:
    """The incoming value wherever there is an incoming row, null or not."""
    return F.when(there, n).otherwise(o)


def fill(n: Column, o: Column, there: Column) -> Column:
    """The incoming value unless it is null."""
    return F.coalesce(n, o)


def old(n: Column, o: Column, there: Column) -> Column:
    """The stored value, always."""
    return o


def sticky_true(n: Column, o: Column, there: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(False)) | F.coalesce(o, F.lit(False)), True).otherwise(F.coalesce(n, o))


def unless(*sentinels) -> Rule:
    """The incoming value unless it is null or one of the sentinels."""
    return lambda n, o, there: F.when(n.isNotNull() & ~n.isin(*sentinels), n).otherwise(F.coalesce(o, n))


def if_positive(n: Column, o: Column, there: Column) -> Column:
    return F.when(n > 0, n).otherwise(F.coalesce(o, n))


def last_of(incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the last by the order columns."""
    if not order:
        return incoming.dropDuplicates(keys)
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return incoming.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = new, order: list[str] | None = None) -> DataFrame:
    """The table after the merge; keys are compared null-safely, columns that incoming lacks stay as they are."""
    rules, coming = rules or {}, last_of(incoming, keys, order)
    there = F.col("i._there").isNotNull()
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    joined = stored.alias("s").join(coming.withColumn("_there", F.lit(True)).alias("i"), on, "full_outer")
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.when(there, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        elif c in incoming.columns:
            out.append(rules.get(c, default)(F.col(f"i.{c}"), F.col(f"s.{c}"), there).alias(c))
        else:
            out.append(F.col(f"s.{c}"))
    return joined.select(*out)


#: Trades: nullable columns fill, others are overwritten, and these have rules of their own.
TRADE_RULES: dict[str, Rule] = {
    "asset_type": unless("unknown"), "has_capital_gains": sticky_true, "filing_id": if_positive, "filing_url": unless(""), "enriched_at": old,
    **dict.fromkeys(("price", "size", "size_range_high", "size_range_low", "comment", "tx_type_extended"), fill),
    **dict.fromkeys(("trade_date_price", "current_price", "price_enriched_at", "estimated_shares", "estimated_value", "price_source", "benchmark_price"), old),
}


def upsert_trades(stored: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    return upsert(stored, incoming, ["tx_id"], TRADE_RULES, new, order)


def from_listing(rows: DataFrame) -> DataFrame:
    """Rows of a listing page as trades: what the page lacks is derived or empty."""
    return rows.withColumns({"asset_id": F.col("tx_id"), "filing_date": F.to_date("pub_date"), "filing_url": F.coalesce("filing_url", F.lit("")), "filing_id": F.coalesce("filing_id", F.lit(0).cast("bigint")), "asset_type": F.coalesce("asset_type", F.lit("unknown")), "ticker": F.when(F.trim("ticker") != "", F.col("ticker"))})


def upsert_politicians(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["politician_id"], {"enriched_at": old})


def upsert_issuers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["issuer_id"], {"enriched_at": old})


def replace_children(stored: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The child rows of the given parents are replaced by the incoming ones; others stay."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*stored.columns).distinct())


def trade_detail(stored: DataFrame, detail: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Fills trades from their detail pages; the asset type only where it is unknown, arrays only by non-empty ones; stamps enriched_at."""
    some = lambda n, o, there: F.when(F.size(n) > 0, n).otherwise(o)
    rules = {"asset_type": lambda n, o, there: F.when((o == "unknown") & n.isNotNull(), n).otherwise(o), "has_capital_gains": sticky_true, "filing_id": if_positive, "filing_url": unless(""), "committees": some, "labels": some}
    known = detail.join(stored.select("tx_id"), "tx_id", "left_semi").withColumn("enriched_at", F.lit(at).cast("timestamp"))
    return upsert(stored, known, ["tx_id"], rules | {"enriched_at": new}, fill)


def complete_performance(feed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Issuers whose performance has all fields; an incomplete one counts as none."""
    whole = F.forall(F.array(*[F.col(f"performance.{f}").isNotNull() for f in fields]), lambda x: x)
    return feed.where(F.col("performance").isNotNull() & whole).select(F.col("_issuerId").alias("issuer_id"), "performance.*").drop("eodPrices")


def replace_memberships(memberships: DataFrame, politicians: DataFrame) -> DataFrame:
    """The whole membership table anew: distinct pairs of politicians that exist."""
    return memberships.dropDuplicates(["politician_id", "committee"]).join(politicians.select("politician_id"), "politician_id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing: the check that stands in for foreign keys."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def stamp_missing(df: DataFrame, at: str | dt.datetime, column: str = "enriched_at") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(at).cast("timestamp")))


def update_prices(stored: DataFrame, found: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Prices found for trades: all three values are taken, the source fills, and every trade that was looked up is stamped."""
    return upsert(stored, found.withColumn("price_enriched_at", F.lit(at).cast("timestamp")), ["tx_id"], {"price_source": fill})


def update_benchmark_prices(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Benchmark prices found for trades, null or not; nothing else of them changes. found: (tx_id, benchmark_price)."""
    return upsert(stored, found.select("tx_id", "benchmark_price").join(stored.select("tx_id"), "tx_id", "left_semi"), ["tx_id"])


def update_current_prices(stored: DataFrame, found: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Current prices of tickers, on all their trades, which are stamped. found: (ticker, price)."""
    new_prices = found.dropDuplicates(["ticker"]).select("ticker", F.col("price").alias("_p"), F.lit(True).alias("_there"))
    out = stored.join(new_prices, "ticker", "left")
    values = {"current_price": F.when(F.col("_there"), F.col("_p")).otherwise(F.col("current_price")), "price_enriched_at": F.when(F.col("_there"), F.lit(at).cast("timestamp")).otherwise(F.col("price_enriched_at"))}
    return out.withColumns(values).select(*stored.columns)


def upsert_stats(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Counts of politicians or issuers: the incoming row replaces the stored one whole."""
    return upsert(stored, incoming, [key])


def upsert_positions(stored: DataFrame, computed: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Positions by politician and ticker: what was computed replaces what was stored and is stamped; others stay."""
    return upsert(stored, computed.withColumn("last_updated", F.lit(at).cast("timestamp")), ["politician_id", "ticker"])


def upsert_mappings(stored: DataFrame, found: DataFrame, cycle: int, at: str | dt.datetime) -> DataFrame:
    """Candidate ids of politicians: the person's id and the cycle anew, known committees stay."""
    rows = found.withColumns({"election_cycle": F.lit(cycle).cast("int"), "last_synced": F.lit(at).cast("timestamp")})
    return upsert(stored, rows, ["politician_id", "fec_candidate_id"], {"committee_ids": fill})


def update_committees(stored: DataFrame, politician_id: str, committees: list[str], at: str | dt.datetime) -> DataFrame:
    """The committee ids of all of a politician's mappings."""
    his = F.col("politician_id") == politician_id
    return stored.withColumns({"committee_ids": F.when(his, F.array(*map(F.lit, committees))).otherwise(F.col("committee_ids")), "last_synced": F.when(his, F.lit(at).cast("timestamp")).otherwise(F.col("last_synced"))})


def upsert_fec_committees(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Committees by id; the cycles are kept as JSON text."""
    rows = incoming.withColumn("cycles", F.to_json("cycles")) if dict(incoming.dtypes).get("cycles", "string") != "string" else incoming
    return upsert(stored, rows, ["committee_id"])


def update_issuer_details(stored: DataFrame, detail: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Issuers from their detail pages: what a page lacks stays, and every issuer with a page is stamped."""
    known = detail.join(stored.select("issuer_id"), "issuer_id", "left_semi").withColumn("enriched_at", F.lit(at).cast("timestamp"))
    return upsert(stored, known, ["issuer_id"], {"enriched_at": new}, fill)


def replace_performance(stored: DataFrame, feed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Performance rows of the issuers in a feed: a whole performance replaces what is stored, an incomplete or missing one removes it. The same goes for prices: use replace_children with the issuers of the feed."""
    return replace_children(stored, complete_performance(feed, fields), feed.select(F.col("_issuerId").alias("issuer_id")), "issuer_id")


def apply_sectors(issuers: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sets gics_sector by ticker, with or without :US. mappings: (ticker, sector)."""
    names = mappings.select(F.regexp_replace("ticker", ":US$", "").alias("_t"), F.col("sector").alias("_s"))
    return issuers.join(names, F.regexp_replace("ticker", ":US$", "") == F.col("_t"), "left").withColumn("gics_sector", F.coalesce("_s", "gics_sector")).drop("_t", "_s")


def insert_donations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored donations and the incoming ones whose sub_id isn't null or known; of several with a sub_id one."""
    fresh = incoming.where("sub_id is not null").dropDuplicates(["sub_id"]).join(stored.select("sub_id"), "sub_id", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


CURSOR_KEYS = ["politician_id", "committee_id", "cycle"]


def save_cursors(stored: DataFrame, moved: DataFrame) -> DataFrame:
    """Cursors after a page: position and time anew, the number of rows accumulated. A null cycle is a key like any other."""
    return upsert(stored, moved, CURSOR_KEYS, {"total_synced": lambda n, o, there: F.coalesce(n, F.lit(0)) + F.coalesce(o, F.lit(0))})


def complete_cursors(stored: DataFrame, done: DataFrame, at: str | dt.datetime) -> DataFrame:
    """Cursors of finished pulls: without a position, stamped, totals kept."""
    marks = done.select(*CURSOR_KEYS).withColumn("last_index", F.lit(None).cast("bigint")).withColumn("last_synced", F.lit(at).cast("timestamp"))
    return upsert(stored, marks, CURSOR_KEYS)


def open_cursors(stored: DataFrame) -> DataFrame:
    return stored.where("last_index is not null")


def due(stored: DataFrame, as_of: str | dt.datetime, hours: int = 24) -> DataFrame:
    """Cursors not synchronised within the last hours."""
    return stored.where(F.coalesce(F.col("last_synced") <= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"), F.lit(True)))


def synced(tables: dict[str, DataFrame], trades: DataFrame, politicians: DataFrame, issuers: DataFrame, members: DataFrame, since: str | dt.date | None = None) -> dict[str, DataFrame]:
    """One round of synchronisation as plans over the tables trades, politicians, issuers and politician_committees: incoming rows from a day on (that day included, as merging is idempotent) are merged, memberships are refreshed whole."""
    some = trades if since is None else trades.where(F.to_date("pub_date") >= F.lit(since).cast("date"))
    people = upsert_politicians(tables["politicians"], politicians)
    return {
        "politicians": people,
        "issuers": upsert_issuers(tables["issuers"], issuers),
        "trades": upsert_trades(tables["trades"], some),
        "politician_committees": replace_memberships(members, people),
    }


# Changes of older tables.


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """Adds what an older table lacks, as nulls, in the order of the schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def backfill_source(trades: DataFrame, source: str = "yahoo") -> DataFrame:
    return trades.withColumn("price_source", F.coalesce("price_source", F.when(F.col("trade_date_price").isNotNull(), F.lit(source))))


def backfill_shares(trades: DataFrame) -> DataFrame:
    """Shares by value where the range gave none."""
    given = (F.col("trade_date_price") > 0) & (F.col("value") > 0)
    return trades.withColumn("estimated_shares", F.coalesce("estimated_shares", F.when(given, F.col("value") / F.col("trade_date_price"))))
