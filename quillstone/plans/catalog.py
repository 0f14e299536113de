"""The registered queries over the adapters' domain tables, each beside the SQL that must give the same rows.

The SQL is written on its own: FIFO matches there by overlapping intervals, as-of prices by ranges, where the
operators use windows and equality joins. Doubles are rounded on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import schemas as S
from quillstone.functions import scalars
from quillstone.operators import anomaly, conflicts, donations, fifo, matching, merge, metrics, portfolio, pricing, reads, statistics, versions
from quillstone.operators.buckets import Buckets
from quillstone.operators.filters import DonationFilter, IssuerFilter, PoliticianFilter, PortfolioFilter, TradeFilter, any_of
from quillstone.sources import contracts, exports, pages, seeds
from quillstone.sources.adapters import AS_OF, JURISDICTIONS, Domain, ctes
from quillstone.sources.shared import shared_folder, staged

_QUERIES: dict[str, tuple[Callable[[Domain], DataFrame], str | None]] = {}


def _add(name: str, make: Callable[[Domain], DataFrame], sql: str | None, *tables: str) -> None:
    _QUERIES[name] = (make, sql if sql is None else (ctes(*tables).rstrip() + (",\n" if sql.lstrip().startswith("+") else "\n") if tables else "") + sql.lstrip().removeprefix("+"))


def r4(*cols: str) -> list[Column]:
    return [F.round(c, 4).alias(c) for c in cols]


def _round_sums() -> list:
    return [F.round("total_amount", 2).alias("total_amount"), "count_donations", F.round("avg_amount", 4).alias("avg_amount")]


# Shared plans.

_braced = lambda sql: sql.replace("{", "{{").replace("}", "}}")


def analytics_trades(d: Domain) -> DataFrame:
    rows = fifo.eligible(d.trades).join(d.issuers.select("issuer_id", "gics_sector"), "issuer_id")
    return rows.withColumn("has_sector_benchmark", F.col("gics_sector").isNotNull() & F.col("benchmark_price").isNotNull())


def closed(d: Domain) -> DataFrame:
    return fifo.closed_lots(analytics_trades(d))


def joined(d: Domain) -> DataFrame:
    return reads.joined_trades(d.trades, d.politicians, d.issuers)


def people_positions(d: Domain, trades: DataFrame | None = None) -> DataFrame:
    return fifo.positions(fifo.eligible(d.trades if trades is None else trades))


def gift_times(d: Domain, *by: str, distinct: bool = False) -> DataFrame:
    """How many rows the listing has for a donation to each committee."""
    return donations.counted(donations.reached(donations.bridge(d.donation_sync, distinct), d.politicians), d.fec_committees, *by)


def issuers_gifts(d: Domain) -> DataFrame:
    return donations.of_issuers(d.donations, d.employer_lookup, d.employer_mappings, d.issuers)


def matched_gifts(d: Domain) -> DataFrame:
    return donations.with_issuers(d.donations, donations.bridge(d.donation_sync), d.employer_lookup, d.employer_mappings, d.issuers)


_FIFO = """+ elig as (select t.*, i.gics_sector, i.gics_sector is not null and t.benchmark_price is not null as flag from trades t join issuers i using (issuer_id)
    where asset_type in ('stock', 'unknown') and tx_type in ('buy', 'receive', 'sell') and shares is not null and price is not null),
f1 as (select *, sum(case when tx_type = 'sell' then -shares else shares end) over (partition by politician_id, ticker order by tx_date, tx_id rows unbounded preceding) as s from elig),
f2 as (select *, s - least(0, min(s) over (partition by politician_id, ticker order by tx_date, tx_id rows unbounded preceding)) as pos from f1),
f3 as (select *, case when tx_type = 'sell' then least(shares, coalesce(lag(pos) over (partition by politician_id, ticker order by tx_date, tx_id), 0)) else 0 end as e from f2),
f4 as (select *, sum(case when tx_type <> 'sell' then shares else 0 end) over (partition by politician_id, ticker order by tx_date, tx_id rows unbounded preceding) as b_end,
    sum(e) over (partition by politician_id, ticker order by tx_date, tx_id rows unbounded preceding) as e_end from f3),
lots as (select * from (select b.politician_id, b.ticker, least(b.b_end, x.e_end) - greatest(b.b_end - b.shares, x.e_end - x.e) as shares, b.tx_id as buy_tx_id, x.tx_id as sell_tx_id,
    b.tx_date as buy_date, x.tx_date as sell_date, b.price as buy_price, x.price as sell_price, b.benchmark_price as buy_benchmark, x.benchmark_price as sell_benchmark, b.gics_sector, b.flag as buy_flag, x.flag as sell_flag
    from f4 b join f4 x on b.politician_id = x.politician_id and b.ticker = x.ticker and b.tx_type <> 'sell' and x.tx_type = 'sell' and x.e > 0 and b.b_end - b.shares < x.e_end and x.e_end - x.e < b.b_end) where shares > 1e-4)"""
_METRICS = (
    _FIFO
    + """,
m1 as (select *, (sell_price - buy_price) / buy_price * 100 as return_pct, cast(sell_date - buy_date as bigint) as holding_days,
    case when buy_benchmark is not null and sell_benchmark is not null and buy_benchmark > 1e-4 then (sell_benchmark - buy_benchmark) / buy_benchmark * 100 end as bench from lots),
tm as (select *, return_pct - bench as alpha, case when holding_days >= 30 then (pow(1 + return_pct / 100, 365.0 / holding_days) - 1) * 100 end as annualized,
    case when bench is not null and buy_flag and sell_flag then 'sector' when bench is not null and not buy_flag and not sell_flag then 'spy' end as benchmark_type from m1)"""
)


def _pm(where: str = "true") -> str:
    return (
        _METRICS
        + f""",
pm as (select politician_id, count(*) as total_trades, count(*) filter (return_pct > 0) as win_count, avg(return_pct) as avg_return, avg(alpha) filter (benchmark_type = 'spy') as avg_alpha_spy,
    avg(alpha) filter (benchmark_type = 'sector') as avg_alpha_sector, cast(floor(sum(holding_days) / count(holding_days)) as bigint) as avg_holding_days, count(*) filter (return_pct > 0) * 100.0 / count(*) as win_rate from tm where {where} group by 1)"""
    )


_FIFO_TABLES = ("trades", "issuers")
_PM = ["win_rate", "avg_return", "avg_alpha_spy", "avg_alpha_sector"]
_PM_SQL = "total_trades, win_count, avg_holding_days, " + ", ".join(f"round({c}, 4) as {c}" for c in _PM)

# Reads.
_JOINED = "trades t join politicians p using (politician_id) join issuers i using (issuer_id)"
_T = ["tx_id", "politician_id", "full_name", "party", "issuer_name", "ticker", "tx_type", "tx_date", "pub_date", "value"]
_T_SQL = "tx_id, politician_id, full_name, party, issuer_name, t.ticker, tx_type, tx_date, pub_date, value"
_add("trades_joined", lambda d: reads.joined_trades(d.trades, d.politicians, d.issuers, d.politician_committees).groupBy("party", "chamber", "gics_sector", F.array_join("committees", ",").alias("committees")).agg(F.count("*").alias("n"), F.sum("value").alias("volume")),
     f"""+ c as (select politician_id, string_agg(committee, ',' order by committee) as committees from politician_committees group by 1)
     select party, chamber, gics_sector, committees, count(*) as n, cast(sum(value) as bigint) as volume from {_JOINED} left join c using (politician_id) group by all""", "politicians", "issuers", "trades", "politician_committees")  # fmt: skip
_add("trades_filtered", lambda d: reads.query_trades(joined(d), TradeFilter(party=("Democrat", "republican"), tx_type=("buy", "sell"), issuer="brand 1", since=dt.date(1997, 1, 1), until=dt.date(1999, 12, 31), name="member 0000"), limit=None).select(*_T),
     f"select {_T_SQL} from {_JOINED} where party in ('democrat', 'republican') and tx_type in ('buy', 'sell') and (issuer_name ilike '%brand 1%' or t.ticker ilike '%brand 1%') and pub_date between date '1997-01-01' and date '1999-12-31' and full_name ilike '%member 0000%'", "politicians", "issuers", "trades")
_add("trades_top_recent", lambda d: reads.query_trades(joined(d), TradeFilter(chamber=("senate",), sector=("energy", "financials")), limit=100).select(*_T),
     f"select {_T_SQL} from {_JOINED} where chamber = 'senate' and sector in ('energy', 'financials') order by pub_date desc nulls last, tx_id limit 100", "politicians", "issuers", "trades")
_add("trades_by_reporting_gap", lambda d: reads.query_trades(joined(d), TradeFilter(country=("gb",), tx_since=dt.date(2000, 1, 1)), "reporting-gap", True, 50).select(*_T, F.col("reporting_gap").cast("bigint").alias("reporting_gap")),
     f"select {_T_SQL}, cast(pub_date - tx_date as bigint) as reporting_gap from {_JOINED} where country = 'gb' and tx_date >= date '2000-01-01' order by reporting_gap, tx_id limit 50", "politicians", "issuers", "trades")
_add("stats_by_issuer", lambda d: reads.trade_stats(d.trades, "issuer_id", "politician_id"),
     "select issuer_id, count(*) as count_trades, count(distinct politician_id) as count_politicians, cast(sum(value) as bigint) as volume, max(tx_date) as date_last_traded from trades group by 1", "trades")
_add("stats_by_politician", lambda d: reads.trade_stats(d.trades, "politician_id", "issuer_id"),
     "select politician_id, count(*) as count_trades, count(distinct issuer_id) as count_issuers, cast(sum(value) as bigint) as volume, max(tx_date) as date_last_traded from trades group by 1", "trades")
_add("politicians_summary", lambda d: reads.query_politicians(d.politicians, reads.trade_stats(d.trades, "politician_id", "issuer_id"), d.politician_committees, PoliticianFilter(chamber=("house",), party=("democrat", "other"))).select("politician_id", "full_name", "state", "party", "count_trades", "count_issuers", "volume", F.array_join("committees", ",").alias("committees")),
     """+ s as (select politician_id, count(*) as count_trades, count(distinct issuer_id) as count_issuers, cast(sum(value) as bigint) as volume from trades group by 1), c as (select politician_id, string_agg(committee, ',' order by committee) as committees from politician_committees group by 1)
     select politician_id, full_name, state, party, count_trades, count_issuers, volume, committees from politicians left join s using (politician_id) left join c using (politician_id) where chamber = 'house' and party in ('democrat', 'other')""", "politicians", "trades", "politician_committees")  # fmt: skip
_add("issuers_summary", lambda d: reads.query_issuers(d.issuers, reads.trade_stats(d.trades, "issuer_id", "politician_id"), IssuerFilter(country=("us",), search="brand"), limit=10).select("issuer_id", "issuer_name", "ticker", "sector", "count_trades", "count_politicians", "volume"),
     """+ s as (select issuer_id, count(*) as count_trades, count(distinct politician_id) as count_politicians, cast(sum(value) as bigint) as volume from trades group by 1)
     select issuer_id, issuer_name, ticker, sector, count_trades, count_politicians, volume from issuers left join s using (issuer_id) where country = 'us' and issuer_name ilike '%brand%' order by volume desc nulls last, issuer_id limit 10""", "issuers", "trades")  # fmt: skip
_add("top_traded_tickers", lambda d: reads.top_traded_tickers(d.trades, 10), "select ticker, count(*) as count_trades from trades where ticker is not null and ticker <> '' group by 1 order by 2 desc, 1 limit 10", "trades")
_add("trades_by_month", lambda d: reads.trades_by_month(d.trades), "select strftime(tx_date, '%Y-%m') as month, count(*) as count_trades, cast(sum(value) as bigint) as volume from trades group by 1", "trades")
_add("volume_by_party", lambda d: reads.volume_by(joined(d), "party"), f"select party, count(*) as count_trades, cast(sum(value) as bigint) as volume from {_JOINED} group by 1", "politicians", "issuers", "trades")
_add("high_water_mark", lambda d: reads.high_water_mark(d.trades), "select count(*) as count_trades, max(pub_date) as max_pub_date from trades", "trades")
_add("volume_rollup", lambda d: reads.rollup_volume(joined(d), "party", "sector"), f"select party, sector, cast(grouping(party, sector) as bigint) as level, count(*) as count_trades, cast(sum(value) as bigint) as volume from {_JOINED} group by rollup(party, sector)", "politicians", "issuers", "trades")

# FIFO, metrics, leaderboards.
_add("fifo_closed_lots", lambda d: closed(d).select("politician_id", "ticker", "buy_tx_id", "sell_tx_id", "buy_date", "sell_date", *r4("shares", "buy_price", "sell_price"), "gics_sector"),
     _FIFO + "\nselect politician_id, ticker, buy_tx_id, sell_tx_id, buy_date, sell_date, round(shares, 4) as shares, round(buy_price, 4) as buy_price, round(sell_price, 4) as sell_price, gics_sector from lots", *_FIFO_TABLES)
_POSITIONS = (
    _FIFO
    + """,
sold as (select buy_tx_id, politician_id, ticker, sum(shares) as shares, sum(shares * (sell_price - buy_price)) as pnl from lots group by all),
pos as (select b.politician_id, b.ticker, sum(b.shares - coalesce(s.shares, 0)) as shares_held, sum((b.shares - coalesce(s.shares, 0)) * b.price) as cost, sum(coalesce(s.pnl, 0)) as realized_pnl
    from f4 b left join sold s on b.tx_id = s.buy_tx_id where b.tx_type <> 'sell' group by all),
positions as (select politician_id, ticker, shares_held, case when shares_held > 1e-4 then cost / shares_held else 0 end as cost_basis, realized_pnl from pos)"""
)
# All politicians' trades as those of one: keys with very many trades, each shared among tasks.
_add("fifo_hot_keys", lambda d: fifo.closed_lots(analytics_trades(d).withColumn("politician_id", F.lit("P")), most=400).select("ticker", "buy_tx_id", "sell_tx_id", *r4("shares")),
     _FIFO.replace("select t.*,", "select t.* replace ('P' as politician_id),") + " select ticker, buy_tx_id, sell_tx_id, round(shares, 4) as shares from lots", *_FIFO_TABLES)
_add("fifo_positions", lambda d: people_positions(d).select("politician_id", "ticker", *r4("shares_held", "cost_basis", "realized_pnl")),
     _POSITIONS + "\nselect politician_id, ticker, round(shares_held, 4) as shares_held, round(cost_basis, 4) as cost_basis, round(realized_pnl, 4) as realized_pnl from positions", *_FIFO_TABLES)
_add("trade_metrics", lambda d: metrics.trade_metrics(closed(d)).select("buy_tx_id", "sell_tx_id", "holding_days", *r4("return_pct", "annualized", "alpha"), "benchmark_type"),
     _METRICS + "\nselect buy_tx_id, sell_tx_id, holding_days, round(return_pct, 4) + 0e0 as return_pct, round(annualized, 4) + 0e0 as annualized, round(alpha, 4) + 0e0 as alpha, benchmark_type from tm", *_FIFO_TABLES)
_add("politician_metrics", lambda d: metrics.politician_metrics(metrics.trade_metrics(closed(d))).select("politician_id", "total_trades", "win_count", "avg_holding_days", *r4(*_PM)),
     _pm() + f"\nselect politician_id, {_PM_SQL} from pm", *_FIFO_TABLES)


def _board(name: str, where: str, order: str, top: int, filters: str = "true", least: int = 1, **options) -> None:
    who = options.pop("who", None)
    _add(name, lambda d: metrics.leaderboard(closed(d), d.politicians, AS_OF, min_trades=least, top=top, who=who, **options).select("rank", "politician_id", "full_name", "party", "state", "total_trades", "win_count", "avg_holding_days", *r4(*_PM, "percentile")),
         _pm(where) + f""",
ranked as (select *, case when count(*) over () > 1 then 1 - (row_number() over (order by avg_return desc nulls last, politician_id) - 1) * 1e0 / (count(*) over () - 1) else 1 end as percentile
    from pm join politicians using (politician_id) where total_trades >= {least} and {filters})
select row_number() over (order by {order} desc nulls last, politician_id) as rank, politician_id, full_name, party, state, {_PM_SQL}, round(percentile, 4) as percentile from ranked order by {order} desc nulls last, politician_id limit {top}""", *_FIFO_TABLES, "politicians")  # fmt: skip


_board("leaderboard", "true", "avg_return", 25)
_board("leaderboard_alpha", "true", "coalesce(avg_alpha_spy, avg_alpha_sector)", 25, "party in ('republican')", sort="alpha", who=PoliticianFilter(party=("republican",)))
_board("leaderboard_1y", f"sell_date >= date '{AS_OF}' - 365", "win_rate", 10, least=5, period="1y", sort="win-rate")
_board("leaderboard_ytd", f"sell_date >= date_trunc('year', date '{AS_OF}')", "avg_return", 25, period="ytd")
_LATEST = _METRICS + """,
latest as (select * from (select *, row_number() over (partition by politician_id, ticker order by sell_date desc, sell_tx_id desc, buy_date desc, buy_tx_id desc) as k from tm) where k = 1)"""  # fmt: skip
_add("trades_with_metrics", lambda d: metrics.trades_with_metrics(d.trades, metrics.trade_metrics(closed(d))).select("tx_id", "tx_type", F.col("holding_days").cast("double").alias("holding_days"), *r4("return_pct", "alpha"), "benchmark_type"),
     _LATEST + """ select t.tx_id, t.tx_type, cast(l.holding_days as double) as holding_days, round(l.return_pct, 4) as return_pct, round(l.alpha, 4) as alpha, l.benchmark_type from trades t left join latest l on t.tx_type = 'sell' and t.politician_id = l.politician_id and t.ticker = l.ticker""", *_FIFO_TABLES)
# The same under the name that it had beside a sample.
_QUERIES["trades_with_metrics_all"] = _QUERIES["trades_with_metrics"]
_add("politicians_with_metrics", lambda d: metrics.politicians_with_metrics(d.politicians, metrics.trade_metrics(closed(d))).select("politician_id", "party", "total_trades", *r4("avg_return", "win_rate", "percentile")),
     _pm() + """ select politician_id, party, total_trades, round(avg_return, 4) as avg_return, round(win_rate, 4) as win_rate, round(percentile * 100, 4) as percentile from politicians left join (select *, case when count(*) over () > 1
     then 1 - (row_number() over (order by avg_return desc nulls last, politician_id) - 1) * 1e0 / (count(*) over () - 1) else 1 end as percentile from pm) using (politician_id)""", *_FIFO_TABLES, "politicians")  # fmt: skip

# Portfolio and conflicts.
_PRICES = "latest_price as (select ticker, max_by(current_price, (price_enriched_at, tx_id)) as current_price from trades where current_price is not null and price_enriched_at is not null group by 1)"
_add("portfolio", lambda d: PortfolioFilter(party=("democrat",)).apply(portfolio.valued(people_positions(d), portfolio.latest_prices(d.trades)), d.politicians).select("politician_id", "ticker", *r4("shares_held", "cost_basis", "current_price", "current_value", "unrealized_pnl", "unrealized_pct")),
     _POSITIONS + f""", {_PRICES}
     select politician_id, ticker, round(shares_held, 4) as shares_held, round(cost_basis, 4) as cost_basis, round(current_price, 4) as current_price, round(shares_held * current_price, 4) as current_value, round((current_price - cost_basis) * shares_held, 4) as unrealized_pnl,
     round(case when current_price is null then null when cost_basis > 1e-4 then (current_price - cost_basis) / cost_basis * 100 else 0 end, 4) as unrealized_pct from positions left join latest_price using (ticker) join politicians using (politician_id) where party = 'democrat' and shares_held > 1e-4""", *_FIFO_TABLES, "politicians")  # fmt: skip
_FIRST = "firsts as (select committee, min(entry) as entry from jurisdictions group by 1), seats as (select distinct c.politician_id, j.sector from politician_committees c join jurisdictions j using (committee) join firsts f on j.committee = f.committee and j.entry = f.entry)"
_add("portfolio_conflict_flags", lambda d: portfolio.with_conflict_flags(PortfolioFilter().apply(people_positions(d), d.politicians), d.issuers, conflicts.committee_sectors(d.politician_committees, d.jurisdictions)).select("politician_id", "ticker", *r4("shares_held"), "gics_sector", F.col("in_committee_sector").cast("string").alias("in_committee_sector")),
     _POSITIONS + f""", {_FIRST} select p.politician_id, p.ticker, round(shares_held, 4) as shares_held, i.gics_sector, case when i.gics_sector is null then null when s.sector is not null then 'true' else 'false' end as in_committee_sector
     from positions p left join issuers i using (ticker) left join seats s on p.politician_id = s.politician_id and i.gics_sector = s.sector where shares_held > 1e-4""", *_FIFO_TABLES, "politicians", "politician_committees", "jurisdictions")  # fmt: skip
_add("option_trade_count", lambda d: portfolio.option_count(d.trades), "select count(*) as count_options from trades where asset_type = 'stock-option'", "trades")
_add("committee_semi_join", lambda d: conflicts.on_committee(d.politicians, d.politician_committees, "hsba").select("politician_id", "full_name"), "select politician_id, full_name from politicians where exists (select 1 from politician_committees c where c.politician_id = politicians.politician_id and committee = 'hsba')", "politicians", "politician_committees")
_add("members_with_committees", lambda d: conflicts.members_with_committees(d.politicians, d.politician_committees), "select politician_id, full_name, string_agg(committee, ', ' order by committee) as committees from politicians join politician_committees using (politician_id) group by all", "politicians", "politician_committees")
_add("committee_conflict_score", lambda d: conflicts.committee_scores(closed(d), conflicts.committee_sectors(d.politician_committees, d.jurisdictions), 5.0).select("politician_id", "scored", "related", *r4("pct")),
     _FIFO + f""", {_FIRST} select * from (select l.politician_id, count(l.gics_sector) as scored, count(s.sector) as related, round(coalesce(count(s.sector) * 100e0 / nullif(count(l.gics_sector), 0), 0), 4) as pct
     from lots l left join seats s on l.politician_id = s.politician_id and l.gics_sector = s.sector group by 1) where pct >= 5""", *_FIFO_TABLES, "politicians", "politician_committees", "jurisdictions")  # fmt: skip

# Donations.
_GIFTS = "donations d join (select politician_id, committee_id from donation_sync) b using (committee_id) join politicians p using (politician_id) left join fec_committees c using (committee_id)"
_G_TABLES = ("politicians", "donations", "donation_sync", "fec_committees")
_SUMS = "round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as total_amount, count(*) as count_donations, round((cast(sum(cast(amount as decimal(18, 4))) as double) / count(amount)), 4) as avg_amount"
_add("donations_detail", lambda d: donations.listed(d.donations, donations.bridge(d.donation_sync), d.politicians, d.fec_committees, DonationFilter(min_amount=50.0, employer="corp", cycle=2024), 200).select("sub_id", "politician_id", "full_name", "committee_name", "contributor_name", "amount"),
     f"select sub_id, politician_id, full_name, c.name as committee_name, contributor_name, amount from {_GIFTS} where amount >= 50 and contributor_employer ilike '%corp%' and d.cycle = 2024 order by amount desc, sub_id, politician_id limit 200", *_G_TABLES)
_add("donations_by_contributor", lambda d: donations.rolled_up_reached(d.donations, gift_times(d), "contributor").select("contributor_name", "contributor_state", *_round_sums(), "max_amount", "first_date", "last_date"),
     f"select coalesce(contributor_name, 'Unknown') as contributor_name, coalesce(contributor_state, '') as contributor_state, {_SUMS}, max(amount) as max_amount, min(receipt_date) as first_date, max(receipt_date) as last_date from {_GIFTS} group by 1, 2", *_G_TABLES)
_add("donations_by_employer", lambda d: donations.rolled_up_reached(d.donations, gift_times(d), "employer").select("contributor_employer", *_round_sums(), "count_contributors"), f"select coalesce(contributor_employer, 'Unknown') as contributor_employer, {_SUMS}, count(distinct contributor_name) as count_contributors from {_GIFTS} group by 1", *_G_TABLES)
_add("donations_by_state", lambda d: donations.rolled_up_reached(d.donations, gift_times(d), "state").select("contributor_state", *_round_sums(), "count_contributors"), f"select coalesce(contributor_state, '') as contributor_state, {_SUMS}, count(distinct contributor_name) as count_contributors from {_GIFTS} group by 1", *_G_TABLES)
_add("donations_by_state_once", lambda d: donations.rolled_up_reached(d.donations, gift_times(d, distinct=True), "state").select("contributor_state", *_round_sums(), "count_contributors"), f"select coalesce(contributor_state, '') as contributor_state, {_SUMS}, count(distinct contributor_name) as count_contributors from {_GIFTS.replace('(select politician_id', '(select distinct politician_id')} group by 1", *_G_TABLES)
_MATCHED = "donations d join employer_lookup l on lower(trim(d.contributor_employer)) = l.raw_employer_lower join employer_mappings m using (normalized_employer) join issuers i on i.ticker = m.issuer_ticker join (select politician_id, committee_id from donation_sync) b using (committee_id)"
_M_TABLES = ("politicians", "donations", "donation_sync", "employer_lookup", "employer_mappings", "issuers")
_add("donor_context", lambda d: donations.donor_context(matched_gifts(d), "P000004", "Consumer Staples", 5).select("contributor_employer", F.round("total_amount", 2).alias("total_amount"), "count_donations"),
     f"select contributor_employer, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as total_amount, count(*) as count_donations from {_MATCHED} where politician_id = 'P000004' and gics_sector = 'Consumer Staples' group by 1 order by cast(sum(cast(amount as decimal(18, 4))) as double) desc, 1 limit 5", *_M_TABLES)
_add("donation_sector_summary", lambda d: donations.sector_summary(issuers_gifts(d), donations.bridge(d.donation_sync)).select("politician_id", "gics_sector", F.round("total_amount", 2).alias("total_amount"), "count_employers", F.col("rank").cast("bigint").alias("rank")),
     f"""+ s as (select politician_id, gics_sector, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as total_amount, count(distinct contributor_employer) as count_employers, row_number() over (partition by politician_id order by cast(sum(cast(amount as decimal(18, 4))) as double) desc, gics_sector) as rank from {_MATCHED} where gics_sector is not null group by 1, 2)
     select * from s where rank <= 5""", *_M_TABLES)  # fmt: skip
_add("donation_totals", lambda d: donations.totals(d.donations, gift_times(d, "politician_id")).select("politician_id", F.round("total_amount", 2).alias("total_amount"), "count_donations"), f"select politician_id, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as total_amount, count(*) as count_donations from {_GIFTS} group by 1 having cast(sum(cast(amount as decimal(18, 4))) as double) is not null", *_G_TABLES)
_add("unmatched_employers", lambda d: donations.unmatched_employers(d.donations, d.employer_lookup), "select distinct contributor_employer from donations d where contributor_employer is not null and contributor_employer <> '' and not exists (select 1 from employer_lookup l where l.raw_employer_lower = lower(d.contributor_employer))", "donations", "employer_lookup")
_add("donation_trade_correlation", lambda d: donations.trade_correlation(d.trades, issuers_gifts(d).withColumn("confidence", F.col("confidence").cast("double")), donations.bridge(d.donation_sync), 0.8).select("politician_id", "ticker", "count_donations", F.round("total_amount", 2).alias("total_amount"), *r4("avg_confidence"), "employers", "count_trades"),
     f"""+ g as (select distinct sub_id, politician_id, issuer_ticker as ticker, amount, cast(confidence as double) as confidence, contributor_employer from {_MATCHED} where confidence >= 0.8),
     a as (select politician_id, ticker, count(distinct sub_id) as count_donations, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as total_amount, round(avg(confidence), 4) as avg_confidence, string_agg(distinct contributor_employer, ', ' order by contributor_employer) as employers from g group by 1, 2),
     t as (select politician_id, ticker, count(*) as count_trades from trades group by 1, 2) select politician_id, ticker, count_donations, total_amount, avg_confidence, employers, count_trades from a join t using (politician_id, ticker)""", *_M_TABLES, "trades")  # fmt: skip
_add("donations_min_amount_by_party", lambda d: d.donations.where("amount >= 20").groupBy("committee_id").agg(F.count("*").alias("_rows")).join(gift_times(d, "party").where(any_of("party", ("democrat", "republican"))), "committee_id").groupBy("party").agg(F.sum(F.col("_rows") * F.col("_times")).alias("n")), f"select party, count(*) as n from {_GIFTS} where party in ('democrat', 'republican') and amount >= 20 group by 1", *_G_TABLES)

# Anomalies.
_add("pre_move_signals", lambda d: anomaly.pre_move_signals(anomaly.later_prices(d.trades)).select("tx_id", "politician_id", "ticker", "direction", "later_date", *r4("later_price", "change_pct")),
     """+ daily as (select ticker, tx_date, min_by(price, tx_id) as later_price from trades group by 1, 2),
     later as (select t.tx_id, t.politician_id, t.ticker, t.tx_type, t.price, min_by(d.later_price, d.tx_date) as later_price, min(d.tx_date) as later_date from (select distinct ticker, tx_date from trades) k join daily d on k.ticker = d.ticker and d.tx_date between k.tx_date + 28 and k.tx_date + 32 join trades t on t.ticker = k.ticker and t.tx_date = k.tx_date group by all)
     select tx_id, politician_id, ticker, (case when tx_type = 'buy' then 'buy' else 'sell' end) || (case when later_price > price then '_before_rise' else '_before_drop' end) as direction, later_date, round(later_price, 4) as later_price, round((later_price - price) / price * 100, 4) as change_pct
     from later where abs((later_price - price) / price * 100) > 10""", "trades")  # fmt: skip
_VOLUME = f"""vol as (select {{0}}, count(*) filter (tx_date between date '{AS_OF}' - 90 and date '{AS_OF}') as recent, count(*) filter (tx_date >= date '{AS_OF}' - 455 and tx_date < date '{AS_OF}' - 90) as baseline from trades group by 1),
sig as (select *, baseline / (365e0 / 90) as usual, case when baseline > 0 then recent / (baseline / (365e0 / 90)) else 0 end as ratio from vol)"""
_add("volume_anomaly", lambda d: anomaly.volume_signals(d.trades, AS_OF, "customer_id").select("customer_id", "recent", "baseline", *r4("usual", "ratio"), "unusual"),
     "+" + _VOLUME.format("customer_id") + " select customer_id, recent, baseline, round(usual, 4) as usual, round(ratio, 4) as ratio, ratio > 2 as unusual from sig", "trades")


def _values(d: Domain, trades: DataFrame | None = None) -> DataFrame:
    trades = d.trades if trades is None else trades
    held = people_positions(d, trades).where(F.col("shares_held") > 0.01).join(portfolio.latest_prices(trades), "ticker")
    return held.join(d.issuers.select("ticker", "gics_sector"), "ticker").select("politician_id", "gics_sector", (F.col("shares_held") * F.col("current_price")).alias("value"))


_HHI = f""", {_PRICES}, sums as (select politician_id, gics_sector, sum(shares_held * current_price) as v from positions join latest_price using (ticker) join issuers using (ticker) where shares_held > 0.01 and gics_sector is not null and shares_held * current_price > 0 group by 1, 2),
w as (select *, v / sum(v) over (partition by politician_id) as w from sums), hhi as (select politician_id, sum(w * w) as hhi, max_by(gics_sector, (w, gics_sector)) as dominant_sector from w group by 1)"""
_add("sector_hhi", lambda d: anomaly.sector_concentration(_values(d)).select("politician_id", *r4("hhi"), "dominant_sector", "concentrated"),
     _POSITIONS + _HHI + " select politician_id, round(hhi, 4) as hhi, dominant_sector, hhi > 0.25 as concentrated from hhi", *_FIFO_TABLES)


def _composite(d: Domain) -> DataFrame:
    # Five plans read the trades, each with joins of its own with orders and parts if they weren't staged.
    trades = staged(d.trades.select("tx_id", "politician_id", "ticker", "tx_type", "tx_date", "shares", "price", "asset_type", "current_price", "price_enriched_at"), "anomaly-trades")
    moves = anomaly.pre_move_signals(anomaly.later_prices(trades)).groupBy("politician_id").agg(F.count("*").alias("pre_moves"))
    return anomaly.composite_scores(moves, anomaly.volume_signals(trades, AS_OF), anomaly.sector_concentration(_values(d, trades)), 0.1, 0.5)


_add("anomaly_composite", lambda d: _composite(d).select("politician_id", F.col("pre_moves").cast("bigint").alias("pre_moves"), *r4("ratio", "hhi", "score", "confidence")),
     _POSITIONS + _HHI + ", " + _VOLUME.format("politician_id") + """, daily as (select ticker, tx_date, min_by(price, tx_id) as later_price from trades group by 1, 2),
     nearest as (select k.ticker, k.tx_date, min_by(d.later_price, d.tx_date) as later_price from (select distinct ticker, tx_date from trades) k join daily d on k.ticker = d.ticker and d.tx_date between k.tx_date + 28 and k.tx_date + 32 group by 1, 2),
     moves as (select politician_id, count(*) as pre_moves from trades join nearest using (ticker, tx_date) where abs((later_price - price) / price * 100) > 10 group by 1),
     parts as (select politician_id, coalesce(pre_moves, 0) as pre_moves, coalesce(ratio, 0) as ratio, coalesce(hhi, 0) as hhi from sig left join moves using (politician_id) left join hhi using (politician_id)),
     scored as (select *, (least(1, pre_moves / 10e0) + least(1, ratio / 5) + least(1, hhi)) / 3 as score, ((pre_moves > 0)::int + (ratio > 0)::int + (hhi > 0)::int) / 3e0 as confidence from parts)
     select politician_id, pre_moves, round(ratio, 4) as ratio, round(hhi, 4) as hhi, round(score, 4) as score, round(confidence, 4) as confidence from scored where score >= 0.1 and confidence >= 0.5""", *_FIFO_TABLES)  # fmt: skip

# Prices.
_add("share_estimates", lambda d: d.trades.select("tx_id", F.round(scalars.range_middle("size_range_low", "size_range_high"), 4).alias("middle"), F.round(scalars.estimated_shares("size_range_low", "size_range_high", "value", "price"), 4).alias("shares")),
     "select tx_id, round((size_range_low + size_range_high) / 2e0, 4) as middle, round(coalesce(case when size_range_low <= size_range_high and price > 0 then (size_range_low + size_range_high) / 2e0 / price end, case when value > 0 and price > 0 then value / price end), 4) as shares from trades", "trades")
_RAW = "case issuer_id % 7 when 0 then ticker || ':US' when 1 then ' ' || ticker || ':LN ' when 2 then '$$' || ticker when 3 then substr(ticker, 1, 2) || '/' || substr(ticker, 3) || ':HK' when 4 then ticker || ':xx' when 5 then '' else substr(ticker, 1, 2) || '.' || substr(ticker, 3) end"
_add("ticker_normalized", lambda d: d.issuers.withColumn("raw", F.expr(_RAW)).select("issuer_id", "raw", scalars.price_ticker("raw").alias("price_ticker"), scalars.exchange_suffix("raw").alias("suffix")),
     f"""+ r as (select issuer_id, {_RAW} as raw from issuers), s as (select *, trim(raw) as t from r)
     select issuer_id, raw, case when t = '' then null when t like '$$%' then substr(t, 3) || '-USD' when contains(t, ':') then replace(replace(split_part(t, ':', 1), '/', '-'), '.', '-') || (case upper(split_part(t, ':', 2)) when 'LN' then '.L' when 'HK' then '.HK' else '' end) else replace(replace(t, '/', '-'), '.', '-') end as price_ticker,
     case when contains(raw, ':') then substr(raw, instr(raw, ':') + 1) else '(none)' end as suffix from s""", "issuers")  # fmt: skip
_ASOF_SQL = """select tx_id, max(p.price_date) as asof_date, round(max_by(p.price, p.price_date), 4) as asof_price from trades t left join {0} p on t.ticker = p.ticker and p.price_date between t.tx_date - 7 and t.tx_date group by tx_id"""
# Over a price table with gaps, as markets have them, so that the look-back counts; and over one with a price for each day of a trade.
_add("price_asof_backfill", lambda d: pricing.as_of_prices(d.trades, d.market_prices).select("tx_id", "asof_date", *r4("asof_price")), _ASOF_SQL.format("market_prices"), "trades", "market_prices")
_add("price_asof_backfill_all", lambda d: pricing.as_of_prices(d.trades, d.prices).select("tx_id", "asof_date", *r4("asof_price")), _ASOF_SQL.format("prices"), "trades", "prices")
_add("benchmark_assignment", lambda d: pricing.benchmarks(d.trades, d.issuers, d.sector_benchmarks).groupBy("gics_sector", "benchmark").agg(F.count("*").alias("n")), "select gics_sector, coalesce(etf, 'SPY') as benchmark, count(*) as n from trades join issuers using (issuer_id) left join (select * from sector_benchmarks where sector is not null) b on b.sector = gics_sector group by 1, 2", "trades", "issuers", "sector_benchmarks")
_add("enrichment_diagnostics", lambda d: pricing.diagnostics(d.trades)["totals"].select("total", "tried", "priced", "failed", *r4("priced_pct")),
     "select count(*) as total, count(price_enriched_at) as tried, count(*) filter (price_enriched_at is not null and price is not null and current_price is not null) as priced, count(*) filter (price_enriched_at is not null and current_price is null) as failed, round(count(*) filter (price_enriched_at is not null and price is not null and current_price is not null) * 100e0 / count(*), 4) as priced_pct from trades", "trades")
_add("enrichment_failed_tickers", lambda d: pricing.diagnostics(d.trades)["tickers"], "select ticker, count(*) as n from trades where price_enriched_at is not null and current_price is null group by 1 order by 2 desc, 1 limit 30", "trades")
_add("enrichment_queue", lambda d: pricing.queue(d.trades, pricing.needs_price(), "tx_id", 500).select("tx_id", "ticker", "tx_date"), "select tx_id, ticker, tx_date from trades where ticker <> '' and tx_date is not null and price_enriched_at is null order by tx_id limit 500", "trades")
_add("benchmark_queue", lambda d: pricing.queue(d.trades, pricing.needs_benchmark(), "tx_id", 500).select("tx_id", "ticker", "tx_date"), "select tx_id, ticker, tx_date from trades where ticker <> '' and tx_date is not null and benchmark_price is null order by tx_id limit 500", "trades")

# Names.
_ENDINGS = "(" + "|".join(x.replace(".", r"\.") for x in scalars.D.COMPANY_ENDINGS) + ")$"
_NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({{0}})), '{_ENDINGS}', ''), '[., ]+$', ''), '\\s+', ' ', 'g'))"
_NONE = "(" + " or ".join(f"starts_with(lower(trim(contributor_employer)), '{x}')" for x in scalars.D.NO_EMPLOYER) + ")"
_add("employer_normalized", lambda d: d.donations.where("contributor_employer is not null").select("contributor_employer").distinct().select("contributor_employer", scalars.employer_name("contributor_employer").alias("normalized"), scalars.is_no_employer("contributor_employer").alias("no_employer")),
     f"select distinct contributor_employer, {_NORMAL.format('contributor_employer')} as normalized, {_NONE} as no_employer from donations where contributor_employer is not null", "donations")
_MATCH = f"""+ e as (select distinct contributor_employer as employer, {_NORMAL.format("contributor_employer")} as normalized from donations where contributor_employer is not null and not {_NONE}),
n as (select issuer_id, ticker, {_NORMAL.format("issuer_name")} as issuer from issuers), x as (select normalized, min(issuer_id) as issuer_id from (select distinct normalized from e) join n on normalized = issuer group by 1)"""
_add("employer_exact_match", lambda d: matching.match_employers(d.donations, d.issuers, 1.1).select("employer", "normalized", "issuer_id", "ticker"), _MATCH + " select employer, normalized, issuer_id, ticker from e join x using (normalized) join n using (issuer_id)", "donations", "issuers")
_add("employer_fuzzy_match", lambda d: matching.match_employers(d.donations, d.issuers, 0.75).select("employer", "normalized", "issuer_id", "ticker", F.round("confidence", 4).alias("confidence"), "match_type"),
     _MATCH + """, s as (select normalized, issuer_id, jaro_winkler_similarity(normalized, issuer) as score from (select distinct normalized from e where normalized not in (select normalized from x) and strlen(normalized) >= 5) cross join n),
     best as (select normalized, max_by(issuer_id, (score, -issuer_id)) as issuer_id, max(score) as confidence from s where score >= 0.75 group by 1)
     select employer, normalized, issuer_id, ticker, round(confidence, 4) as confidence, match_type from e join (select normalized, issuer_id, 1e0 as confidence, 'exact' as match_type from x union all select normalized, issuer_id, confidence, 'fuzzy' from best) using (normalized) join n using (issuer_id)""", "donations", "issuers")  # fmt: skip
# Hundreds of names on both sides: parts by name and type, once with the endings and misspellings of donors, once as listed companies.
_FIRMS = ("select distinct concat(case when p_size % 3 = 0 then replace(p_name, 'e', '') when p_size % 3 = 1 then concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3)) else p_name end, ' ', lower(p_type), case when p_size % 2 = 0 then ' Inc.' else ', LLC' end) as contributor_employer from part",
          "select dense_rank() over (order by name) as issuer_id, concat(name, ' Corp') as issuer_name, concat('T', dense_rank() over (order by name)) as ticker from (select distinct concat(p_name, ' ', lower(p_type)) as name from part where p_partkey % 7 <> 3) n")
_add("employer_names_near", lambda d: matching.match_employers(*[d.spark.sql(q.replace("from part", "from {part}"), part=d.base("part")) for q in _FIRMS]).select("employer", "normalized", F.col("issuer_id").cast("bigint").alias("issuer_id"), "ticker", F.round("confidence", 4).alias("confidence"), "match_type"),
     f"""with donations as ({_FIRMS[0]}), issuers as ({_FIRMS[1]}),\n""" + _MATCH.lstrip("+ ") + """, s as (select normalized, issuer_id, jaro_winkler_similarity(normalized, issuer) as score from (select distinct normalized from e where normalized not in (select normalized from x) and strlen(normalized) >= 5) cross join n),
     best as (select normalized, max_by(issuer_id, (score, -issuer_id)) as issuer_id, max(score) as confidence from s where score >= 0.85 group by 1)
     select employer, normalized, cast(issuer_id as bigint) as issuer_id, ticker, round(confidence, 4) as confidence, match_type from e join (select normalized, issuer_id, 1e0 as confidence, 'exact' as match_type from x union all select normalized, issuer_id, confidence, 'fuzzy' from best) using (normalized) join n using (issuer_id)""")  # fmt: skip
_LEGISLATORS = "select struct(concat('B', politician_id) as bioguide, array(concat('H', politician_id), concat('S', politician_id)) as fec) as id, struct('x' as first, upper(last_name) as last, full_name as official_full) as name, array(struct('rep' as type, '' as start, '' as end, 'ZZ' as state, '' as party), struct('rep' as type, '' as start, '' as end, lower(state) as state, '' as party)) as terms from {p}"
_add("fec_name_match", lambda d: matching.match_legislators(d.spark.sql(_LEGISLATORS, p=d.politicians), d.politicians.unionByName(d.politicians.where("party = 'other'").withColumn("politician_id", F.concat("politician_id", F.lit("x"))))),
     "+ p as (select politician_id, last_name, state from politicians where party <> 'other') select politician_id, 'B' || politician_id as bioguide_id, unnest(['H' || politician_id, 'S' || politician_id]) as fec_candidate_id from p", "politicians")
_add("committee_class", lambda d: matching.classified(d.fec_committees).select("committee_id", "committee_type", "designation", "class"),
     "select committee_id, committee_type, designation, case when designation = 'D' then 'leadership_pac' when designation = 'J' then 'joint_fundraising' when committee_type in ('H', 'S', 'P') then case when designation in ('A', 'P') then 'campaign' else 'other' end when committee_type in ('X', 'Y', 'Z') then 'party' when committee_type in ('N', 'Q', 'O') then 'pac' else 'other' end as class from fec_committees", "politicians", "donation_sync", "fec_committees")

# Merges.
_SPLIT = ["tx_id", "asset_type", "value", "comment", "current_price"]


def _merged(d: Domain) -> DataFrame:
    stored = d.trades.where("tx_date < date '2000-01-01'").select(*_SPLIT)
    coming = d.trades.where("tx_date >= date '1999-01-01'").select("tx_id", F.when(F.col("value") % 2 == 0, "unknown").otherwise(F.col("asset_type")).alias("asset_type"), (F.col("value") + 1).alias("value"), F.when(F.col("value") % 3 == 0, F.col("comment")).alias("comment"), F.lit(0.0).alias("current_price"))
    return merge.upsert_trades(stored, coming)


_add("merge_trades", lambda d: _merged(d).select("tx_id", "asset_type", "value", "comment", *r4("current_price")),
     """+ s as (select tx_id, asset_type, value, comment, current_price from trades where tx_date < date '2000-01-01'),
     n as (select tx_id, case when value % 2 = 0 then 'unknown' else asset_type end as asset_type, value + 1 as value, case when value % 3 = 0 then comment end as comment from trades where tx_date >= date '1999-01-01')
     select coalesce(n.tx_id, s.tx_id) as tx_id, case when n.asset_type <> 'unknown' then n.asset_type else coalesce(s.asset_type, n.asset_type) end as asset_type, coalesce(n.value, s.value) as value, coalesce(n.comment, s.comment) as comment, round(s.current_price, 4) as current_price from s full join n on s.tx_id = n.tx_id""", "trades")  # fmt: skip
_add("merge_donations_dedup", lambda d: merge.insert_donations(d.donations.where("cast(sub_id as bigint) % 3 = 0"), d.donations.unionByName(d.donations)).groupBy("committee_id").agg(F.count("*").alias("n"), F.round(donations.money(), 2).alias("amount")), "select committee_id, count(*) as n, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as amount from donations group by 1", "donations")
_add("backfill_shares", lambda d: merge.backfill_shares(d.trades.select("tx_id", "value", F.col("price").alias("trade_date_price"), F.when(F.col("asset_type") == "stock", F.col("shares")).alias("estimated_shares"))).select("tx_id", *r4("estimated_shares")), "select tx_id, round(case when asset_type = 'stock' then shares when price > 0 and value > 0 then value / price end, 4) as estimated_shares from trades", "trades")
_add("membership_replace", lambda d: merge.replace_memberships(d.politician_committees.unionByName(d.politician_committees), d.politicians.where("chamber = 'house'")), "select politician_id, committee from politician_committees where politician_id in (select politician_id from politicians where chamber = 'house')", "politicians", "politician_committees")
_add("orphan_donations", lambda d: merge.orphans(d.donations, d.fec_committees, "committee_id").groupBy("committee_id").agg(F.count("*").alias("n")), "select committee_id, count(*) as n from donations where committee_id not in (select committee_id from fec_committees) group by 1", "donations", "politicians", "donation_sync", "fec_committees")

# Merges of touched buckets, and statistics that add up.
def _bucket_store(d: Domain) -> Buckets:
    return Buckets(d.spark, shared_folder(d.spark, "buckets"), 32)


def _touched(d: Domain) -> DataFrame:
    """The trades of one politician in a hundred come again; only their buckets are written anew."""
    store, columns = _bucket_store(d), ["tx_id", "politician_id", "asset_type", "value", "comment"]
    rows = d.trades.select(*columns)
    store.create(trades=(rows, ["politician_id"]))
    store.merge(trades=(rows.where("cast(substr(politician_id, 2) as bigint) % 100 = 7").withColumns({"value": F.col("value") + 5, "comment": F.when(F.col("value") % 2 == 0, F.col("comment"))}), merge.upsert_trades))
    return store.read("trades")


_add("merge_touched_buckets", _touched, "select tx_id, politician_id, asset_type, value + case when cast(substr(politician_id, 2) as bigint) % 100 = 7 then 5 else 0 end as value, comment from trades", "trades")


def _pulled(d: Domain) -> DataFrame:
    """Donations and the cursors of their pull, published together page by page; the second page brings rows of the first again."""
    store = _bucket_store(d)
    gifts = d.donations.select("sub_id", "committee_id", "amount", "receipt_date")
    cursor = lambda rows: rows.groupBy(F.lit("P").alias("politician_id"), "committee_id", F.lit(2024).alias("cycle")).agg(F.max(F.col("sub_id").cast("bigint")).alias("last_index"), F.count("*").alias("total_synced"))
    pages = [gifts.where("receipt_date < date '2024-01-16'"), gifts.where("receipt_date >= date '2024-01-11'")]
    store.create(donations=(gifts.where("false"), ["sub_id"]), cursors=(cursor(gifts.where("false")), ["committee_id"]))
    for number, page in enumerate(pages):
        store.merge(number, donations=(page, merge.insert_donations), cursors=(cursor(page), merge.save_cursors))
    total = store.read("donations").groupBy("committee_id").agg(F.count("*").alias("n"), F.round(donations.money(), 2).alias("amount"))
    return store.read("cursors").join(total, "committee_id").select("committee_id", "last_index", "total_synced", "n", "amount")


_add("pull_published_together", _pulled,
     """+ c as (select committee_id, max(cast(sub_id as bigint)) filter (receipt_date >= date '2024-01-11') as late, max(cast(sub_id as bigint)) as last_index, count(*) filter (receipt_date < date '2024-01-16') + count(*) filter (receipt_date >= date '2024-01-11') as total_synced, count(*) as n, round(cast(sum(cast(amount as decimal(18, 4))) as double), 2) as amount from donations group by 1)
     select committee_id, coalesce(late, last_index) as last_index, total_synced, n, amount from c""", "donations")  # fmt: skip


def _incremental(d: Domain, key: str, other: str) -> DataFrame:
    """Three runs of new trades, each added to what is kept."""
    runs = [d.trades.where(f"tx_id % 3 = {k}") for k in range(3)]
    states, known = statistics.state(runs[0], key, other), statistics.pairs(runs[0], key, other)
    for run in runs[1:]:
        states, known = statistics.added(states, statistics.state(run, key, other), key), statistics.added_pairs(known, statistics.pairs(run, key, other))
    out = statistics.told(states, known, key)
    return out.select(key, "count_trades", "volume", "date_last", "count_partners", (F.abs(F.col("about_partners") - F.col("count_partners")) <= 1 + 0.1 * F.col("count_partners")).alias("sketch_near"))


for _key, _other in (("issuer_id", "politician_id"), ("politician_id", "issuer_id")):
    _add(f"stats_added_{_key.removesuffix('_id')}", lambda d, k=_key, o=_other: _incremental(d, k, o), f"select {_key}, count(*) as count_trades, cast(sum(cast(value as decimal(28, 2))) as double) as volume, max(tx_date) as date_last, count(distinct {_other}) as count_partners, true as sketch_near from trades group by 1", "trades")

# Versions of tables, a round of synchronisation, mappings, records with faults.
def _aged(d: Domain) -> dict[str, DataFrame]:
    """Tables as version 6 kept them: some trades priced, few with shares."""
    trades = d.trades.select("tx_id", "value", F.when(F.col("tx_id") % 5 != 0, F.col("price")).alias("trade_date_price"), F.when(F.col("asset_type") == "stock", F.col("shares")).alias("estimated_shares"), F.lit(None).cast("double").alias("estimated_value"))
    return {"trades": trades, "issuers": d.issuers.drop("gics_sector"), "meta": d.spark.createDataFrame([("schema_version", "5")], "key string, value string")}


_add("trades_migrated", lambda d: versions.migrated(d.spark, _aged(d))["trades"].select("tx_id", *r4("estimated_shares", "estimated_value"), "price_source", "benchmark_price"),
     "+ t as (select *, case when tx_id % 5 <> 0 then price end as p, case when asset_type = 'stock' then shares end as s from trades) select tx_id, round(coalesce(s, case when p > 0 and value > 0 then value / p end), 4) as estimated_shares, case when s is null and p > 0 and value > 0 then cast(value as double) end as estimated_value, case when p is not null then 'yahoo' end as price_source, cast(null as double) as benchmark_price from t", "trades")
_add("issuers_migrated", lambda d: versions.migrated(d.spark, _aged(d), sectors=seeds.sector_mappings(d.spark, _SECTOR_FILE))["issuers"].select("issuer_id", "ticker", "gics_sector"),
     "select issuer_id, ticker, case when issuer_id between 1 and 19 then case when issuer_id % 3 = 0 then 'Health Care' else 'Energy' end end as gics_sector from issuers", "issuers")


def _round(d: Domain) -> dict[str, DataFrame]:
    """A round from a day on: trades of that day and later come again with other values, older ones are left."""
    stored = {"trades": d.trades.where("pub_date < date '1998-01-01'").select("tx_id", "pub_date", "value", "comment"), "politicians": d.politicians.where("chamber = 'house'").select("politician_id", "full_name", F.lit(AS_OF).cast("timestamp").alias("enriched_at")), "issuers": d.issuers.where("issuer_id < 10").select("issuer_id", "issuer_name", F.lit(None).cast("timestamp").alias("enriched_at")), "politician_committees": d.politician_committees.where("false")}
    coming = d.trades.select("tx_id", "pub_date", (F.col("value") + 1).alias("value"), F.lit(None).cast("string").alias("comment"))
    people = d.politicians.select("politician_id", F.upper("full_name").alias("full_name"), F.lit(None).cast("timestamp").alias("enriched_at"))
    return merge.synced(stored, coming, people, d.issuers.select("issuer_id", "issuer_name"), d.politician_committees.unionByName(d.politician_committees), "1997-01-01")


_add("synced_trades", lambda d: _round(d)["trades"], "select tx_id, pub_date, value + case when pub_date >= date '1997-01-01' then 1 else 0 end as value, case when pub_date < date '1998-01-01' then comment end as comment from trades", "trades")
_add("synced_politicians", lambda d: _round(d)["politicians"].select("politician_id", "full_name", F.to_date("enriched_at").alias("enriched_at")), f"select politician_id, upper(full_name) as full_name, case when chamber = 'house' then date '{AS_OF}' end as enriched_at from politicians", "politicians")
_add("synced_committees", lambda d: _round(d)["politician_committees"], "select politician_id, committee from politician_committees", "politicians", "politician_committees")
_add("children_replaced", lambda d: merge.replace_children(d.politician_committees, d.politician_committees.where("committee < 'hsm'").select("politician_id", F.upper("committee").alias("committee")), d.politicians.where("chamber = 'senate'"), "politician_id"),
     "select c.politician_id, c.committee from politician_committees c join politicians p using (politician_id) where chamber <> 'senate' union all select politician_id, upper(committee) from politician_committees where committee < 'hsm'", "politicians", "politician_committees")
_add("trade_details_filled", lambda d: merge.trade_detail(d.trades.select("tx_id", "asset_type", "comment", F.lit(None).cast("timestamp").alias("enriched_at")), d.trades.where("tx_id % 2 = 0").select("tx_id", F.lit("etf").alias("asset_type"), F.when(F.col("value") % 2 == 0, F.lit("seen")).alias("comment")), AS_OF).select("tx_id", "asset_type", "comment", F.to_date("enriched_at").alias("enriched_at")),
     f"select tx_id, case when tx_id % 2 = 0 and asset_type = 'unknown' then 'etf' else asset_type end as asset_type, case when tx_id % 2 = 0 and value % 2 = 0 then 'seen' else comment end as comment, case when tx_id % 2 = 0 then date '{AS_OF}' end as enriched_at from trades", "trades")
_add("stats_stored", lambda d: merge.upsert_stats(reads.trade_stats(d.trades, "issuer_id", "politician_id").where("issuer_id < 15").withColumn("count_trades", F.lit(0).cast("bigint")).select("issuer_id", "count_trades"), d.trades.where("issuer_id > 5").groupBy("issuer_id").agg(F.count("*").alias("count_trades")), "issuer_id"),
     "select issuer_id, case when issuer_id > 5 then count(*) else 0 end as count_trades from trades group by 1", "trades")
_mappings = lambda d, ids, c: d.politicians.select("politician_id", F.concat(F.lit(ids), "politician_id").alias("fec_candidate_id"), F.concat(F.lit("B"), "politician_id").alias("bioguide_id"), c.alias("committee_ids"))
_add("mappings_stored", lambda d: merge.update_committees(merge.upsert_mappings(_mappings(d, "H", F.array(F.lit("C1"))).withColumns({"election_cycle": F.lit(2022), "last_synced": F.lit(None).cast("timestamp")}), _mappings(d, "H", F.lit(None).cast("array<string>")).where("party = 'democrat'").unionByName(_mappings(d, "S", F.array(F.lit("C2"))).where("party = 'other'")), 2024, AS_OF), "P000002", ["C8", "C9"], AS_OF).select("politician_id", "fec_candidate_id", F.array_join("committee_ids", ",").alias("committees"), "election_cycle", F.to_date("last_synced").alias("last_synced")),
     f"""+ m as (select politician_id, 'H' || politician_id as fec_candidate_id, 'C1' as committees, case when party = 'democrat' then 2024 else 2022 end as election_cycle, case when party = 'democrat' then date '{AS_OF}' end as last_synced from politicians
     union all select politician_id, 'S' || politician_id, 'C2', 2024, date '{AS_OF}' from politicians where party = 'other')
     select politician_id, fec_candidate_id, case when politician_id = 'P000002' then 'C8,C9' else committees end as committees, election_cycle, case when politician_id = 'P000002' then date '{AS_OF}' else last_synced end as last_synced from m""", "politicians")  # fmt: skip
_FAULTY = """concat('{"_txId":', case when tx_id % 7 = 1 then concat('"', tx_id, '"') else cast(tx_id as string) end, ',"_politicianId":"', politician_id, '","txType":"', case when tx_id % 11 = 2 then 'lease' else tx_type end, '"', case when tx_id % 5 = 3 then '' else concat(',"txDate":"', cast(tx_date as string), '"') end, ',"value":', value, case when tx_id % 13 = 4 then '' else '}' end)"""
_FAULTS = "case when tx_id % 13 = 4 then 'no JSON' else concat_ws('|', case when tx_id % 7 = 1 then '$._txId: not integer' end, case when tx_id % 11 = 2 then '$.txType: not among its values' end, case when tx_id % 5 = 3 then '$.txDate: missing' end) end"


def _records(d: Domain) -> DataFrame:
    texts = d.spark.sql(f"select tx_id, {_braced(_FAULTY)} as text from {{t}}", t=d.trades)
    return contracts.checked(texts, contracts.Contract(contracts.TRADE), "text")


_add("records_taken", lambda d: contracts.parted(_records(d))[0].select("tx_id", F.col("record._politicianId").alias("politician_id"), F.col("record.txType").alias("tx_type"), F.col("record.txDate").alias("tx_date"), "record.value"),
     f"select tx_id, politician_id, tx_type, tx_date, value from trades where {_FAULTS} = ''", "trades")
_add("records_in_quarantine", lambda d: contracts.parted(_records(d))[1].select("tx_id", "text", F.array_join("errors", "|").alias("broken")), f"select tx_id, {_FAULTY} as text, {_FAULTS} as broken from trades where {_FAULTS} <> ''", "trades")

_failed = "price_enriched_at is not null and current_price is null"
_add("enrichment_report", lambda d: pricing.report(d.trades),
     f"""+ f as (select count(*) as failed from trades where {_failed}), c as (select count(*) as total, count(price_enriched_at) as tried, count(*) filter (price_enriched_at is not null and price is not null and current_price is not null) as priced, count(*) filter ({_failed}) as failed from trades),
     t as (select ticker, count(*) as n from trades where {_failed} group by 1 order by 2 desc, 1 limit 30)
     select 'trades' as section, item, n, round(100e0 * n / nullif(total, 0), 4) as pct from (select total, unnest(['total', 'tried', 'priced', 'failed']) as item, unnest([total, tried, priced, failed]) as n from c)
     union all select 'priced of tried', asset_type, count(current_price), round(100e0 * count(current_price) / count(*), 4) from trades where price_enriched_at is not null group by 2
     union all select 'reasons', case when ticker is null or ticker = '' then 'no ticker' when tx_date is null then 'no date' else 'no price found' end, count(*), round(100e0 * count(*) / any_value(failed), 4) from trades, f where {_failed} group by 2
     union all select 'tickers', coalesce(ticker, ''), n, round(100e0 * n / failed, 4) from t, f""", "trades")  # fmt: skip
_stamped = lambda df, rest: df.withColumn("enriched_at", F.when(F.expr(rest), F.lit(AS_OF).cast("timestamp")))
_add("unenriched_counts", lambda d: pricing.unenriched({"trades": (_stamped(d.trades, "tx_id % 3 <> 0"), "tx_id"), "politicians": (_stamped(d.politicians, "party = 'other'"), "politician_id"), "issuers": (_stamped(d.issuers, "true"), "issuer_id")}),
     """select 'trades' as "table", count(*) as n, cast(min(tx_id) as string) as first_id from trades where tx_id % 3 = 0 union all select 'politicians', count(*), min(politician_id) from politicians where party <> 'other' union all select 'issuers', 0, null""", "trades", "politicians")  # fmt: skip
_add("politicians_mapped", lambda d: matching.mapped_politicians(d.politicians, d.donation_sync.where("cycle is null").unionByName(d.donation_sync.where("cycle is null"))).select("politician_id", "full_name"),
     "select distinct p.politician_id, full_name from politicians p join donation_sync s on s.politician_id = p.politician_id where s.cycle is null", "politicians", "donation_sync")

# Pages and formats.
_add("html_extract", lambda d: d.base("pages").select("page_id", F.regexp_extract("html", r"<html lang=\"([a-z]+)\"", 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).cast("bigint").alias("links"), scalars.filing_id(F.concat("url", F.lit("/"), "page_id", F.lit(".pdf?x=1"))).alias("filing_id")),
     r"""select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, cast(len(regexp_extract_all(html, 'href="([^"]+)"', 1)) as bigint) as links, case when contains(url, '?') then try_cast(nullif(regexp_extract(split_part(url, '?', 1), '(?:^|/)([0-9]+)(?:\.pdf)*$', 1), '') as bigint) else page_id end as filing_id from pages""")  # fmt: skip
_add("compact_number_parse", lambda d: d.trades.select("tx_id", scalars.format_value("value").alias("shown"), scalars.compact_number(scalars.format_value("value")).alias("read")),
     "+ v as (select tx_id, case when value >= 1000000 then printf('$%.1fM', value / 1e6) when value >= 1000 then printf('$%.1fK', value / 1e3) else '$' || value end as shown from trades) select tx_id, shown, cast(round(cast(regexp_replace(shown, '[$KM]', '', 'g') as double) * case when shown like '%M' then 1e6 when shown like '%K' then 1e3 else 1 end) as bigint) as read from v", "trades")


# Tables kept by hand, and pages: the texts are made of the domain tables, the SQL reads those tables.
_SECTOR_FILE = "mappings:\n" + "".join(f"  - ticker: BR{i:02d}{':US' if i % 2 else ''}\n    sector: {'energy' if i % 3 else 'Health Care'}\n" for i in range(1, 20))
_ALIAS_FILE = "aliases:\n" + "".join(f'  - from: "BR{i:02d}"\n    to: {"~" if i % 4 == 0 else f"X{i}"}\n' for i in range(1, 30, 3))
_COMMITTEE_FILE = "committees:\n" + "".join(f"  - committee_name: {c}\n    chamber: {'House' if c.startswith('h') else 'Senate'}\n    full_name: Committee {i}\n    sectors: [{', '.join(x.upper() for x in ss)}]\n" for i, (c, ss) in enumerate(JURISDICTIONS))
_EMPLOYER_FILE = "".join(f'[[mapping]]\nemployer_names = ["Brand {i} Holdings Inc", "BRAND {i} HOLDINGS LLC"]\nissuer_ticker = "BR{i:02d}"\nsector = "Energy"\nconfidence = 1.0\n' for i in (2, 7, 12, 3, 99))
_add("sectors_from_file", lambda d: merge.apply_sectors(d.issuers, seeds.sector_mappings(d.spark, _SECTOR_FILE)).select("issuer_id", "ticker", "gics_sector"),
     "select issuer_id, ticker, case when issuer_id between 1 and 19 then case when issuer_id % 3 = 0 then 'Health Care' else 'Energy' end else gics_sector end as gics_sector from issuers", "issuers")
_add("committee_sectors_from_file", lambda d: conflicts.committee_sectors(d.politician_committees, seeds.jurisdictions(d.spark, _COMMITTEE_FILE).select("entry", "committee", "sector")).select("politician_id", F.array_join("sectors", ", ").alias("sectors")),
     f"+ {_FIRST} select politician_id, string_agg(distinct sector, ', ' order by sector) as sectors from seats group by 1", "politician_committees", "jurisdictions")
_add("ticker_aliases", lambda d: pricing.resolved_tickers(d.trades.select("tx_id", "ticker"), seeds.ticker_aliases(d.spark, _ALIAS_FILE)).select("tx_id", "ticker", "price_ticker"),
     "select tx_id, ticker, case when (issuer_id - 1) % 3 = 0 and issuer_id < 30 then case when issuer_id % 4 = 0 then null else 'X' || issuer_id end else ticker end as price_ticker from trades", "trades")
_add("employers_from_file", lambda d: d.donations.where("contributor_employer is not null").withColumn("raw_employer_lower", F.rtrim(F.lower(F.trim("contributor_employer")), F.lit("."))).join(seeds.seeded_employers(seeds.employer_seeds(d.spark, _EMPLOYER_FILE), d.issuers)[1], "raw_employer_lower").groupBy("contributor_employer", "normalized_employer").agg(F.count("*").alias("n")),
     "select contributor_employer, 'brand 2 holdings' as normalized_employer, count(*) as n from donations where contributor_employer = 'Brand 2 Holdings Inc.' group by 1", "donations")
_add("tickers_resolved", lambda d: matching.resolve_tickers(d.trades.select(F.regexp_replace("ticker", "BR0", "BR").alias("ticker")).distinct(), d.issuers.withColumn("ticker", F.when(F.col("issuer_id") % 2 == 0, F.concat("ticker", F.lit(":US"))).otherwise(F.col("ticker"))).withColumn("ticker", F.regexp_replace("ticker", "BR0", "BR"))),
     "+ w as (select distinct replace(ticker, 'BR0', 'BR') as ticker, issuer_id from trades) select ticker, ticker || case when issuer_id % 2 = 0 then ':US' else '' end as issuer_ticker from w", "trades")
_add("committees_resolved", lambda d: matching.resolve_committees(d.politicians, [matching.committees_of(d.donation_sync.where("cycle is null").groupBy("politician_id").agg(F.collect_list("committee_id").alias("committee_ids"))), matching.committees_of(d.donation_sync.groupBy("politician_id").agg(F.collect_list(F.concat("committee_id", F.lit("x"))).alias("committee_ids")))]).select("politician_id", F.array_join("committee_ids", ",").alias("committees")),
     "select politician_id, coalesce(string_agg(distinct committee_id, ',') filter (cycle is null), string_agg(distinct committee_id || 'x', ',')) as committees from donation_sync group by 1", "donation_sync")
_CARD_BODY = """concat('["$","a",null,{"href":"/politicians/', politician_id, '","children":[{"className":"cell--name","children":"', full_name, '"},{"className":"party--', party, '"},{"className":"us-state-full--', lower(substr(state, 1, 2)), '"},{"className":"cell--count-trades","a":{"children":"Trades"},"b":{"children":"', cast(cast(substr(politician_id, 2) as bigint) * 7 % 5000 as string), '"}},{"className":"cell--count-issuers","a":{"children":"Issuers"},"b":{"children":"12"}},{"className":"cell--volume","a":{"children":"Volume"},"b":{"children":"$1.5M"}},{"className":"cell--last-traded","a":{"children":"Last Traded"},"b":{"children":"2001-05-06"}}]}]')"""
_add("politician_cards", lambda d: pages.politician_cards(d.spark.sql(f"select concat('<script>self.__next_f.push([1,', substr(to_json(array({_braced(_CARD_BODY)})), 2, length(to_json(array({_braced(_CARD_BODY)}))) - 2), '])</script>') as html from {{p}}", p=d.politicians)),
     "select politician_id, full_name as name, party, upper(substr(state, 1, 2)) as state, cast(substr(politician_id, 2) as bigint) * 7 % 5000 as trades, cast(12 as bigint) as issuers, cast(1500000 as bigint) as volume, date '2001-05-06' as last_traded from politicians", "politicians")
_TRADE_BODY = """concat('{"trades":[{"tradeId":', tx_id, '0,"filingUrl":"http://x/other.pdf"},{"tradeId":', tx_id, ',"size":', value, ',"filingUrl":"http://x/', tx_id, '.pdf","assetType":"', asset_type, '"}]}')"""
_add("trade_detail_pages", lambda d: pages.trade_details(d.spark.sql(f"select tx_id as trade_id, concat('<script>self.__next_f.push([1,', substr(to_json(array({_braced(_TRADE_BODY)})), 2, length(to_json(array({_braced(_TRADE_BODY)}))) - 2), '])</script>') as html from {{t}}", t=d.trades)).select("trade_id", "size", "filing_url", "asset_type"),
     "select tx_id as trade_id, value as size, 'http://x/' || tx_id || '.pdf' as filing_url, asset_type from trades", "trades")
_LISTING_BODY = """concat('1:{"data":[{"_txId":', tx_id, ',"txType":"', upper(tx_type), '","value":', value, ',"comment":"a ] \\\\" b","issuer":{"issuerTicker":"', ticker, '"}}]}')"""
_add("trade_listing_pages", lambda d: pages.trades_of(pages.feed_rows(d.spark.sql(f"select concat('<script>self.__next_f.push([1,', substr(to_json(array({_braced(_LISTING_BODY)})), 2, length(to_json(array({_braced(_LISTING_BODY)}))) - 2), '])</script>') as html from {{t}}", t=d.trades), "_txId", S.FEED_TRADE)).select("tx_id", "tx_type", "value", "ticker", "comment"),
     "select tx_id, tx_type, value, ticker, 'a ] \" b' as comment from trades", "trades")


def _cursors(d: Domain) -> DataFrame:
    every = d.donation_sync.withColumns({"last_index": F.lit(100).cast("bigint"), "total_synced": F.lit(7).cast("bigint"), "last_synced": F.lit(None).cast("timestamp")})
    moved = d.donation_sync.where("cycle is not null").withColumns({"last_index": F.lit(200).cast("bigint"), "total_synced": F.lit(5).cast("bigint")})
    return merge.complete_cursors(merge.save_cursors(every, moved), d.donation_sync.where("cycle is null"), AS_OF)


_add("donation_cursors", lambda d: _cursors(d).select("politician_id", "committee_id", "cycle", "last_index", "total_synced", F.to_date("last_synced").alias("last_synced")),
     f"select politician_id, committee_id, cycle, cast(case when cycle is not null then 200 end as bigint) as last_index, cast(case when cycle is not null then 12 else 7 end as bigint) as total_synced, case when cycle is null then date '{AS_OF}' end as last_synced from donation_sync", "donation_sync")
_add("cursors_open", lambda d: merge.open_cursors(_cursors(d)).select("politician_id", "committee_id"), "select politician_id, committee_id from donation_sync where cycle is not null", "donation_sync")
_add("positions_stored", lambda d: merge.upsert_positions(people_positions(d).where("ticker < 'BR12'").select("politician_id", "ticker", F.lit(0.0).alias("shares_held"), F.lit(None).cast("timestamp").alias("last_updated")), people_positions(d).where("ticker >= 'BR06'").select("politician_id", "ticker", "shares_held"), AS_OF).select("politician_id", "ticker", *r4("shares_held"), F.to_date("last_updated").alias("last_updated")),
     _POSITIONS + f" select politician_id, ticker, case when ticker >= 'BR06' then round(shares_held, 4) else 0 end as shares_held, case when ticker >= 'BR06' then date '{AS_OF}' end as last_updated from positions", *_FIFO_TABLES)
_add("prices_stored", lambda d: merge.update_current_prices(d.trades.select("tx_id", "ticker", "current_price", F.col("price_enriched_at").cast("timestamp").alias("price_enriched_at")), d.issuers.where("issuer_id % 3 = 0").select("ticker", F.when(F.col("issuer_id") % 2 == 0, F.col("issuer_id") * 1.5).alias("price")), AS_OF).select("tx_id", *r4("current_price"), F.to_date("price_enriched_at").alias("price_enriched_at")),
     f"select tx_id, round(case when issuer_id % 3 = 0 then case when issuer_id % 2 = 0 then issuer_id * 1.5e0 end else current_price end, 4) as current_price, case when issuer_id % 3 = 0 then date '{AS_OF}' else price_enriched_at end as price_enriched_at from trades", "trades")
_add("trades_as_xml", lambda d: exports.xml_rows(d.trades.select("tx_id", "ticker", "value", F.when(F.col("value") % 2 == 0, F.array("owner", "tx_type")).alias("labels")), "trade"),
     "select '<trade><tx_id>' || tx_id || '</tx_id><ticker>' || ticker || '</ticker><value>' || value || '</value>' || case when value % 2 = 0 then '<labels><label>' || owner || '</label><label>' || tx_type || '</label></labels>' else '' end || '</trade>' as line from trades", "trades")
_add("trades_as_markdown", lambda d: exports.markdown_rows(d.trades.select("tx_id", F.concat("ticker", F.lit("|x")).alias("ticker"), F.when(F.col("value") % 2 == 0, F.col("owner")).alias("owner"))),
     r"select '| ' || tx_id || ' | ' || ticker || '\|x | ' || coalesce(case when value % 2 = 0 then owner end, '') || ' |' as line from trades", "trades")


def _bound(make: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Domain(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillstone.streaming import incremental

    return {n: _bound(make) for n, (make, _) in _QUERIES.items()} | incremental.queries()


def oracle_sql() -> dict[str, str]:
    from quillstone.streaming import incremental

    from quillstone.streaming import incremental

    return {n: sql for n, (_, sql) in _QUERIES.items() if sql is not None} | incremental.oracle_sql() | incremental.oracle_sql()
