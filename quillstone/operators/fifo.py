"""First-in-first-out matching of sells to lots, as two window passes over one partitioning.

Buys and receipts add lots, sells consume them, exchanges and unknown types do nothing. A sell beyond what is
held sells what is held. Laid end to end, lots cover an interval each of the shares ever bought and effective
sells cover an interval each of the shares ever sold; the slices between neighbouring ends are the matches.
Holdings after each trade are the running sum reflected at zero, which gives the effective size of a sell.

A key with very many trades needn't be one task's work: all of these runs are associative. With `most` a key of
more trades is cut into stretches of time, and in the second pass of shares; each stretch is run through by
itself, and a row for each stretch carries sums, lows and nearest lots across to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices and holdings up to this many shares are none.
EPSILON = 1e-4
KEYS = ("politician_id", "ticker")
_LOT = ("tx_id", "tx_date", "price", "benchmark_price", "gics_sector", "has_sector_benchmark")


def eligible(trades: DataFrame) -> DataFrame:
    """Trades with shares and a price, of stocks or an unknown kind."""
    return trades.where(F.col("shares").isNotNull() & F.col("price").isNotNull() & F.col("asset_type").isin("stock", "unknown"))


def _stretches(rows: DataFrame, keys: tuple[str, ...], at: Column, most: int) -> DataFrame:
    """Adds _part: stretches of equal width in `at` of each key with more than `most` rows, 0 elsewhere. Values that are equal share a part, so a part may hold more rows than `most` where they crowd."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to")).where((F.col("_n") > most) & (F.col("_to") > F.col("_from")))
    parts = F.ceil(F.col("_n") / most)
    placed = F.least(parts - 1, F.floor((at - F.col("_from")) / (F.col("_to") - F.col("_from")) * parts))
    return rows.join(large, list(keys), "left").withColumn("_part", F.coalesce(placed, F.lit(0)).cast("bigint")).drop("_n", "_from", "_to")


def _with_ends(trades: DataFrame, keys: tuple[str, ...], most: int | None) -> DataFrame:
    """Buys and sells with _sold, the effective size of a sell, and _end, where a lot or sell ends among all shares bought or sold."""
    buys, sells = F.col("tx_type").isin("buy", "receive"), F.col("tx_type") == "sell"
    rows = trades.where(buys | sells).withColumn("_x", F.when(buys, F.col("shares")).otherwise(-F.col("shares")))
    rows = _stretches(rows, keys, F.datediff("tx_date", F.lit("1970-01-01")).cast("double"), most) if most else rows.withColumn("_part", F.lit(0))
    part = [*keys, "_part"]
    order = Window.partitionBy(*part).orderBy("tx_date", "tx_id")
    running, before = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumn("_sum", F.sum("_x").over(running)).withColumn("_low", F.min("_sum").over(running))
    if most:
        # What earlier stretches sum up to, and the lowest sum within them.
        of_part = rows.groupBy(*part).agg(F.sum("_x").alias("_total"), F.min("_low").alias("_least")).withColumn("_base", F.coalesce(F.sum("_total").over(before), zero))
        of_part = of_part.withColumn("_floor", F.coalesce(F.min(F.col("_base") + F.col("_least")).over(before), zero)).select(*part, "_base", "_floor")
        rows = rows.join(of_part, part)
    else:
        rows = rows.withColumn("_base", zero).withColumn("_floor", zero)
    held = lambda total, low: total - F.least(zero, low)
    rows = rows.withColumn("_held", held(F.col("_base") + F.col("_sum"), F.least("_floor", F.col("_base") + F.col("_low"))))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_held").over(order), held(F.col("_base"), F.col("_floor"))))
    rows = rows.withColumn("_sold", F.when(sells, F.least("shares", "_before")).otherwise(zero)).withColumn("_lot", F.when(buys, F.col("shares")).otherwise(zero))
    rows = rows.withColumn("_end", F.when(buys, F.sum("_lot").over(running)).otherwise(F.sum("_sold").over(running)))
    if most:
        of_part = rows.groupBy(*part).agg(F.sum("_lot").alias("_lots"), F.sum("_sold").alias("_sells"))
        of_part = of_part.select(*part, F.coalesce(F.sum("_lots").over(before), zero).alias("_lots_before"), F.coalesce(F.sum("_sells").over(before), zero).alias("_sells_before"))
        rows = rows.join(of_part, part).withColumn("_end", F.col("_end") + F.when(buys, F.col("_lots_before")).otherwise(F.col("_sells_before")))
    return rows.where(buys | (F.col("_sold") > 0))


def slices(trades: DataFrame, keys: tuple[str, ...] = KEYS, most: int | None = None) -> DataFrame:
    """A row for each match of a lot and a sell, and for each part of a lot that stays (sell is null).

    trades: keys, tx_id, tx_date, tx_type, shares, price and what else of _LOT there is. Keys aren't null. With most, keys of more trades are shared among tasks.
    """
    lot = F.struct(*[c for c in _LOT if c in trades.columns])
    buys = F.col("tx_type").isin("buy", "receive")
    ends = _with_ends(trades, keys, most).select(*keys, "_end", F.col("tx_id").alias("_id"), F.when(buys, lot).alias("_buy"), F.when(~buys, lot).alias("_sell"))
    ends = _stretches(ends, keys, F.col("_end"), most) if most else ends.withColumn("_part", F.lit(0))
    part = [*keys, "_part"]
    # From the far end back, so that each frame grows by a row: the nearest lot and sell at or beyond an end.
    back = Window.partitionBy(*part).orderBy(F.col("_end").desc(), F.col("_id").desc())
    so_far = back.rowsBetween(Window.unboundedPreceding, 0)
    cut = ends.withColumn("buy", F.last("_buy", ignorenulls=True).over(so_far)).withColumn("sell", F.last("_sell", ignorenulls=True).over(so_far)).withColumn("_next", F.lead("_end").over(back))
    if most:
        # The nearest lot and sell of the stretches beyond, and the last end of the stretch before.
        near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_end", "_id"))).alias(c)
        of_part = ends.groupBy(*part).agg(near("_buy"), near("_sell"), F.max("_end").alias("_top"))
        beyond = Window.partitionBy(*keys).orderBy(F.col("_part").desc())
        nearest = lambda c: F.last(c, ignorenulls=True).over(beyond.rowsBetween(Window.unboundedPreceding, -1))
        of_part = of_part.select(*part, nearest("_buy").alias("_far_buy"), nearest("_sell").alias("_far_sell"), F.lead("_top").over(beyond).alias("_top_before"))
        cut = cut.join(of_part, part).withColumns({"buy": F.coalesce("buy", "_far_buy"), "sell": F.coalesce("sell", "_far_sell"), "_next": F.coalesce("_next", "_top_before")})
    cut = cut.withColumn("shares", F.col("_end") - F.coalesce("_next", F.lit(0.0)))
    return cut.where((F.col("shares") > EPSILON) & F.col("buy").isNotNull()).select(*keys, "shares", "buy", "sell")


def closed_lots(trades: DataFrame, keys: tuple[str, ...] = KEYS, most: int | None = None) -> DataFrame:
    """A row for each (lot, sell) match: sizes, dates, prices and benchmarks of both; the sector is the lot's."""
    cut = slices(trades, keys, most).where(F.col("sell").isNotNull())
    has = lambda c: c in trades.columns
    out = [*keys, "shares", F.col("buy.tx_id").alias("buy_tx_id"), F.col("sell.tx_id").alias("sell_tx_id"), F.col("buy.tx_date").alias("buy_date"), F.col("sell.tx_date").alias("sell_date"), F.col("buy.price").alias("buy_price"), F.col("sell.price").alias("sell_price")]
    if has("benchmark_price"):
        out += [F.col("buy.benchmark_price").alias("buy_benchmark"), F.col("sell.benchmark_price").alias("sell_benchmark")]
    if has("gics_sector"):
        out.append(F.col("buy.gics_sector").alias("gics_sector"))
    if has("has_sector_benchmark"):
        out += [F.col("buy.has_sector_benchmark").alias("buy_flag"), F.col("sell.has_sector_benchmark").alias("sell_flag")]
    return cut.select(*out)


def positions(trades: DataFrame, keys: tuple[str, ...] = KEYS, most: int | None = None) -> DataFrame:
    """(keys, shares_held, cost_basis, realized_pnl): cost_basis is the average price of the shares held, 0 where none are."""
    open_, cost = F.col("sell").isNull(), F.col("shares") * F.col("buy.price")
    total = slices(trades, keys, most).groupBy(*keys).agg(
        F.sum(F.when(open_, F.col("shares")).otherwise(0.0)).alias("shares_held"),
        F.sum(F.when(open_, cost).otherwise(0.0)).alias("_cost"),
        F.sum(F.when(~open_, F.col("shares") * (F.col("sell.price") - F.col("buy.price"))).otherwise(0.0)).alias("realized_pnl"),
    )
    return total.withColumn("cost_basis", F.when(F.col("shares_held") > EPSILON, F.col("_cost") / F.col("shares_held")).otherwise(0.0)).select(*keys, "shares_held", "cost_basis", "realized_pnl")
