"""Committee jurisdictions and how much of a politician's trading lies within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_jurisdictions(jurisdictions: DataFrame) -> DataFrame:
    """(committee, sector): where a code has several entries the first holds. jurisdictions: (entry, committee, sector)."""
    first = jurisdictions.groupBy("committee").agg(F.min("entry").alias("entry"))
    return jurisdictions.join(first, ["committee", "entry"], "left_semi").select("committee", "sector")


def committee_sectors(memberships: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """(politician_id, sectors): all sectors of a politician's committees, sorted; committees without a jurisdiction add none."""
    return memberships.join(first_jurisdictions(jurisdictions), "committee").groupBy("politician_id").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))


def committee_scores(lots: DataFrame, sectors: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """Closed lots with a sector, those within the politician's committee sectors, and their share in percent (0 where there are none)."""
    rows = lots.join(sectors, "politician_id", "left")
    related = F.col("gics_sector").isNotNull() & F.coalesce(F.array_contains("sectors", F.col("gics_sector")), F.lit(False))
    out = rows.groupBy("politician_id").agg(F.count("gics_sector").alias("scored"), F.count_if(related).alias("related"))
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("related"), F.col("scored")) * 100, F.lit(0.0))).where(F.col("pct") >= least_pct)


def on_committee(politicians: DataFrame, memberships: DataFrame, code: str) -> DataFrame:
    return politicians.join(memberships.where(F.col("committee") == code), "politician_id", "left_semi")


def members_with_committees(politicians: DataFrame, memberships: DataFrame) -> DataFrame:
    """Only politicians with a committee; all their codes as one text."""
    lists = memberships.groupBy("politician_id").agg(F.array_join(F.array_sort(F.collect_list("committee")), ", ").alias("committees"))
    return politicians.select("politician_id", "full_name").join(lists, "politician_id")
