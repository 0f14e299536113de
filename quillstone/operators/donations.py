"""Campaign donations: listings, roll-ups, employers' issuers and the trades behind them.

The bridge from a committee to its politicians may hold several rows for a committee; listings and roll-ups
over it repeat a donation for each, as the bridge says. `bridge` with distinct=True gives one row for each
politician and committee instead.

Few committees stand before many politicians, so donations are summed for each committee before they meet the
bridge: a committee's sums count as often as it has rows in the bridge, and no donation is repeated for each of them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.filters import DonationFilter


def money(column: str = "amount") -> Column:
    """The sum of amounts, in decimals until it is whole: no order of the rows changes it."""
    return F.sum(F.col(column).cast("decimal(18, 4)")).cast("double")


def bridge(sync: DataFrame, distinct: bool = False) -> DataFrame:
    out = sync.select("politician_id", "committee_id")
    return out.distinct() if distinct else out


def listed(donations: DataFrame, links: DataFrame, politicians: DataFrame, committees: DataFrame, spec: DonationFilter | None = None, limit: int | None = None) -> DataFrame:
    """Donations with their politician and, where known, their committee's name and class; largest first.

    With a limit only the donations that can be among the first are listed for each of their politicians.
    """
    spec = spec or DonationFilter()
    people = reached(links, politicians)
    if limit:
        # Each donation left has a row at least, so the first ones by amount and id, with all that tie, hold all rows wanted. What a filter says of politicians holds for the bridge.
        gifts, people = donations.where(replace(spec, politician_id=None).predicate()), people.where(DonationFilter(politician_id=spec.politician_id).predicate())
        place = F.rank().over(Window.orderBy(F.desc("amount"), "sub_id"))
        donations = gifts.join(people.select("committee_id").distinct(), "committee_id", "left_semi").withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    rows = donations.join(people, "committee_id").join(committees.select("committee_id", F.col("name").alias("committee_name"), "committee_type", "designation"), "committee_id", "left")
    rows = rows.where(spec.predicate())
    return rows.orderBy(F.desc("amount"), "sub_id", "politician_id").limit(limit) if limit else rows


def reached(links: DataFrame, politicians: DataFrame) -> DataFrame:
    """The bridge with its politicians: (politician_id, committee_id, full_name, party, state)."""
    return links.join(politicians.select("politician_id", "full_name", "party", "state"), "politician_id")


def counted(people: DataFrame, committees: DataFrame, *by: str) -> DataFrame:
    """(committee_id, by, _times): how many rows of a listing a donation to the committee has, for each value of `by`."""
    known = committees.groupBy("committee_id").agg(F.count("*").alias("_known"))
    rows = people.groupBy("committee_id", *by).agg(F.count("*").alias("_times")).join(known, "committee_id", "left")
    return rows.select("committee_id", *by, (F.col("_times") * F.coalesce("_known", F.lit(1))).alias("_times"))


def _amounts() -> list[Column]:
    """What is kept of the amounts of equal donors and committees, exactly: a decimal sum, and counts of rows and of amounts."""
    return [F.sum(F.col("amount").cast("decimal(18, 4)")).alias("_sum"), F.count("*").alias("_rows"), F.count("amount").alias("_amounts")]


def _told() -> list[Column]:
    """Sums, counts and averages of such states, each repeated _times."""
    times = F.col("_times").cast("decimal(10, 0)")
    total = F.sum((F.col("_sum") * times).cast("decimal(38, 4)")).cast("double")
    return [total.alias("total_amount"), F.sum(F.col("_rows") * F.col("_times")).alias("count_donations"), (total / F.sum(F.col("_amounts") * F.col("_times"))).alias("avg_amount")]


#: The columns that a view groups by, and what stands for their nulls.
_VIEWS = {"contributor": {"contributor_name": "Unknown", "contributor_state": ""}, "employer": {"contributor_employer": "Unknown"}, "state": {"contributor_state": ""}}


def _keys(by: str) -> list[Column]:
    if by not in _VIEWS:
        raise ValueError(f"unknown view: {by}")
    return [F.coalesce(c, F.lit(none)).alias(c) for c, none in _VIEWS[by].items()]


def rolled_up(rows: DataFrame, by: str) -> DataFrame:
    """by: contributor, employer or state; sums, counts and averages, and what else belongs to that view."""
    keys = _keys(by)
    sums = [money().alias("total_amount"), F.count("*").alias("count_donations"), (money() / F.count("amount")).alias("avg_amount")]
    if by == "contributor":
        return rows.groupBy(*keys).agg(*sums, F.max("amount").alias("max_amount"), F.min("receipt_date").alias("first_date"), F.max("receipt_date").alias("last_date"))
    return rows.groupBy(*keys).agg(*sums, F.count_distinct("contributor_name").alias("count_contributors"))


def rolled_up_reached(donations: DataFrame, times: DataFrame, by: str) -> DataFrame:
    """The same over the listing of the donations, which is never made. times: (committee_id, _times), of `counted`."""
    keys, names = _keys(by), list(_VIEWS[by])
    if by == "contributor":
        of_committee = donations.groupBy(*keys, "committee_id").agg(*_amounts(), F.max("amount").alias("_most"), F.min("receipt_date").alias("_first"), F.max("receipt_date").alias("_last"))
        return of_committee.join(times, "committee_id").groupBy(*names).agg(*_told(), F.max("_most").alias("max_amount"), F.min("_first").alias("first_date"), F.max("_last").alias("last_date"))
    donor = F.col("contributor_name").alias("_donor")
    of_committee = donations.groupBy(*keys, donor, "committee_id").agg(*_amounts())
    return of_committee.join(times, "committee_id").groupBy(*names).agg(*_told(), F.count_distinct("_donor").alias("count_contributors"))


def employer_key(column: str = "contributor_employer") -> Column:
    return F.lower(F.trim(F.col(column)))


def of_issuers(donations: DataFrame, lookup: DataFrame, mappings: DataFrame, issuers: DataFrame) -> DataFrame:
    """Donations whose employer is an issuer. The lookups are small and are left to a size-checked broadcast."""
    keyed = donations.withColumn("raw_employer_lower", employer_key())
    names = mappings.join(issuers.select(F.col("ticker").alias("issuer_ticker"), "gics_sector", "sector", "issuer_name"), "issuer_ticker")
    return keyed.join(lookup, "raw_employer_lower").join(names, "normalized_employer")


def with_issuers(donations: DataFrame, links: DataFrame, lookup: DataFrame, mappings: DataFrame, issuers: DataFrame) -> DataFrame:
    """Donations whose employer is an issuer, for each politician they reach."""
    return of_issuers(donations, lookup, mappings, issuers).join(links, "committee_id")


def donor_context(matched: DataFrame, politician_id: str, sector: str, limit: int) -> DataFrame:
    rows = matched.where((F.col("politician_id") == politician_id) & (F.col("gics_sector") == sector))
    return rows.groupBy("contributor_employer").agg(money().alias("total_amount"), F.count("*").alias("count_donations")).orderBy(F.desc("total_amount"), "contributor_employer").limit(limit)


def sector_summary(matched: DataFrame, links: DataFrame, top: int = 5) -> DataFrame:
    """For each politician the sectors whose employees gave most, ranked. matched: donations of issuers' employees."""
    of_committee = matched.where("gics_sector is not null").groupBy("committee_id", "gics_sector", "contributor_employer").agg(*_amounts())
    times = links.groupBy("politician_id", "committee_id").agg(F.count("*").alias("_times"))
    sums = of_committee.join(times, "committee_id").groupBy("politician_id", "gics_sector").agg(_told()[0], F.count_distinct("contributor_employer").alias("count_employers"))
    order = Window.partitionBy("politician_id").orderBy(F.desc("total_amount"), "gics_sector")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def totals(donations: DataFrame, times: DataFrame) -> DataFrame:
    """Each politician's total and count; no row where there is no amount. times: (committee_id, politician_id, _times), of `counted`."""
    of_committee = donations.groupBy("committee_id").agg(*_amounts())
    return of_committee.join(times, "committee_id").groupBy("politician_id").agg(*_told()[:2]).where("total_amount is not null")


def unmatched_employers(donations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct employers that the lookup doesn't know, compared in lower case only, without trimming."""
    rows = donations.where("contributor_employer is not null and contributor_employer != ''").select("contributor_employer").distinct()
    return rows.join(lookup, F.lower("contributor_employer") == F.col("raw_employer_lower"), "left_anti")


def trade_correlation(trades: DataFrame, matched: DataFrame, links: DataFrame, min_confidence: float) -> DataFrame:
    """Politicians who traded an issuer whose employees gave to them: donors, amounts, employers, and the number of trades.

    matched: donations of issuers' employees. Trades and donations are each summed before they meet, so neither
    multiplies the other; and politicians of the same committees have the same donations, which are summed once for
    each set of committees.
    """
    sets = links.groupBy("politician_id").agg(F.sort_array(F.collect_set("committee_id")).alias("_set"))
    of_set = sets.select("_set").distinct().select("_set", F.explode("_set").alias("committee_id"))
    row = ["sub_id", "ticker", "amount", "confidence", "contributor_employer"]
    reached_by = matched.where(F.col("confidence") >= min_confidence).withColumn("ticker", F.col("issuer_ticker")).select("committee_id", *row).join(of_set, "committee_id").select("_set", *row).distinct()
    gifts = reached_by.groupBy("_set", "ticker").agg(
        F.count_distinct("sub_id").alias("count_donations"), money().alias("total_amount"), F.avg("confidence").alias("avg_confidence"),
        F.array_join(F.array_sort(F.collect_set("contributor_employer")), ", ").alias("employers"))
    deals = trades.groupBy("politician_id", "ticker").agg(F.count("*").alias("count_trades"))
    return gifts.join(sets, "_set").drop("_set").join(deals, ["politician_id", "ticker"]).where("count_donations > 0")
