"""Reference tables that people keep by hand: sectors, jurisdictions, ticker aliases, employers and legislators.

The files are small and are read on the driver, checked whole, and become dimension tables. A wrong sector or
chamber and a repeated key are errors that name the entry.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import validation
from quillstone.functions.scalars import employer_name
from quillstone.operators.matching import resolve_tickers

CHAMBERS = ("House", "Senate")


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading these files takes PyYAML") from e
    return yaml.safe_load(text)


def _entries(text: str, key: str) -> list[dict]:
    found = (_yaml(text) or {}).get(key)
    if not isinstance(found, list):
        raise ValueError(f"no list of {key}")
    return found


def _once(kind: str, keys: list[str]) -> None:
    seen: set[str] = set()
    for k in keys:
        if k in seen:
            raise ValueError(f"repeated {kind}: {k}")
        seen.add(k)


def sector_mappings(spark: SparkSession, text: str) -> DataFrame:
    """(ticker, sector) of a list `mappings`; sectors in their official spelling, a ticker once."""
    rows = _entries(text, "mappings")
    _once("ticker", [r["ticker"] for r in rows])
    return spark.createDataFrame([(r["ticker"], validation.gics_sector(r["sector"])) for r in rows], "ticker string, sector string")


def jurisdictions(spark: SparkSession, text: str) -> DataFrame:
    """(entry, committee, chamber, full_name, notes, sector) of a list `committees`, a row for each sector. A code may stand more than once; entry tells the order."""
    out = []
    for i, r in enumerate(_entries(text, "committees")):
        if r["chamber"] not in CHAMBERS:
            raise ValueError(f"chamber of {r['committee_name']}: {r['chamber']}")
        out += [(i, r["committee_name"], r["chamber"], r.get("full_name"), r.get("notes"), validation.gics_sector(s)) for s in r["sectors"]]
    return spark.createDataFrame(out, "entry bigint, committee string, chamber string, full_name string, notes string, sector string")


def ticker_aliases(spark: SparkSession, text: str) -> DataFrame:
    """(raw, alias) of a list `aliases`; an alias of null says that the ticker has no price. A ticker once."""
    rows = _entries(text, "aliases")
    _once("alias", [r["from"] for r in rows])
    return spark.createDataFrame([(r["from"], r.get("to")) for r in rows], "raw string, alias string")


def employer_seeds(spark: SparkSession, text: str) -> DataFrame:
    """(raw_employer_lower, normalized_employer, ticker, sector, confidence, match_type) of TOML tables `mapping`, a row for each spelling."""
    rows = [(name, m["issuer_ticker"], validation.gics_sector(m["sector"]) if m.get("sector") else None, float(m.get("confidence", 1.0))) for m in tomllib.loads(text).get("mapping", []) for name in m["employer_names"]]
    table = spark.createDataFrame(rows, "name string, ticker string, sector string, confidence double")
    return table.select(F.lower(F.trim("name")).alias("raw_employer_lower"), employer_name("name").alias("normalized_employer"), "ticker", "sector", "confidence", F.lit("exact").alias("match_type"))


def seeded_employers(seeds: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds as mappings (normalized_employer, issuer_ticker, confidence, match_type) with tickers as the issuers have them, and lookups (raw_employer_lower, normalized_employer). Tickers that no issuer has are left out."""
    known = resolve_tickers(seeds.select("ticker").distinct(), issuers).where("issuer_ticker is not null")
    rows = seeds.join(known, "ticker")
    return rows.select("normalized_employer", "issuer_ticker", "confidence", "match_type").dropDuplicates(["normalized_employer"]), rows.select("raw_employer_lower", "normalized_employer").dropDuplicates(["raw_employer_lower"])


_LEGISLATOR = "id struct<bioguide: string, fec: array<string>>, name struct<first: string, last: string, official_full: string>, terms array<struct<type: string, state: string, party: string>>"


def legislators(spark: SparkSession, *texts: str) -> DataFrame:
    """The legislators of several files (current ones, former ones), one after the other."""
    out = []
    for text in texts:
        for r in _yaml(text) or []:
            who, name = r.get("id", {}), r.get("name", {})
            terms = [(t.get("type"), t.get("state"), t.get("party")) for t in r.get("terms", [])]
            out.append(((who.get("bioguide"), [str(x) for x in who.get("fec") or []]), (name.get("first"), name.get("last"), name.get("official_full")), terms))
    return spark.createDataFrame(out, _LEGISLATOR)


def confirmed_employers(spark: SparkSession, path: str, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A reviewed CSV of employers to mappings and lookups, as seeded_employers gives them. Rows without a confirmed ticker that an issuer has, or without a name, are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("employer", "normalized", "confirmed_ticker")])
    some = rows.where("confirmed_ticker != '' and employer != '' and normalized != ''")
    seeds = some.select(F.lower("employer").alias("raw_employer_lower"), F.col("normalized").alias("normalized_employer"), F.col("confirmed_ticker").alias("ticker"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("match_type"))
    return seeded_employers(seeds, issuers)
