"""Captured pages and feed files to typed rows.

Payloads of pages are found with regular expressions in the JVM; only the isolation of a JSON value by its
matching bracket is an Arrow UDF: one pass over a text's strings and brackets gives all spans at once, so time is
linear in the text whatever its nesting.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import schemas as S

_PUSH = "self.__next_f.push([1,"
#: The inside of a JSON string. Runs without an escape are taken whole, so that the matcher's stack doesn't grow with the text.
_INSIDE = r'((?:[^"\\]++|\\.)*+)'


def payload(html: str = "html") -> Column:
    """All pushed strings of a page, unescaped and joined; null where there is none. What follows a mark is read as JSON, which ends where the string does."""
    parts = F.slice(F.split(F.col(html), r"\Q" + _PUSH + r"\E"), 2, 1 << 30)
    texts = F.transform(parts, lambda p: F.get(F.from_json(F.concat(F.lit("["), p), "array<string>"), F.lit(0)))
    return F.when(F.size(parts) > 0, F.array_join(texts, ""))


#: What structure follows from: whole strings, and brackets outside them. A string ends with its line at the latest, so a stray quote in plain text spoils no other line.
_TOKEN = re.compile(r'"(?:[^"\\\n]++|\\.)*+"|[\[\]{}]')


class Structure:
    """The arrays and objects of a text, found in one pass with a stack: where each begins and ends, and what it lies in.

    A bracket that closes nothing of its kind is plain text. `keyed` are the objects that have `key` as a key of their own.
    """

    def __init__(self, text: str, key: str | None = None):
        self.text, self.opens, self.ends, self.parents, self.keyed = text, [], [], [], set()
        quoted, stack = None if key is None else json.dumps(key), []
        for m in _TOKEN.finditer(text):
            at = m.start()
            ch = text[at]
            if ch == '"':
                if stack and m.end() - at == len(quoted or "") and m[0] == quoted and text[m.end() : m.end() + 1] == ":" and text[self.opens[stack[-1]]] == "{":
                    self.keyed.add(stack[-1])
            elif ch in "[{":
                self.opens.append(at)
                self.ends.append(0)
                self.parents.append(stack[-1] if stack else -1)
                stack.append(len(self.opens) - 1)
            elif stack and text[self.opens[stack[-1]]] == ("[" if ch == "]" else "{"):
                self.ends[stack.pop()] = at + 1

    def begun(self, at: int) -> int:
        """The array or object that begins at a place, or -1."""
        k = bisect_left(self.opens, at)
        return k if k < len(self.opens) and self.opens[k] == at else -1

    def value(self, k: int) -> str | None:
        return self.text[self.opens[k] : self.ends[k]] if k >= 0 and self.ends[k] else None

    def around(self, at: int) -> int:
        """The innermost array or object that holds a place, or -1."""
        k = bisect_right(self.opens, at) - 1
        while k >= 0 and self.ends[k] <= at:
            k = self.parents[k]
        return k


def value_at(text: str, start: int) -> str | None:
    """The array or object that begins at a place; brackets within strings don't count."""
    part = Structure(text[start:])
    return part.value(part.begun(0))


def value_after(text: str, mark: str, opening: str = "{") -> str | None:
    """The first object (or array) after a mark."""
    at = text.find(mark)
    at = text.find(opening, at + len(mark)) if at >= 0 else -1
    return value_at(text, at) if at >= 0 else None


def array_with_key(text: str, key: str) -> str | None:
    """The first "data" array whose first item has the key."""
    if key not in text:
        return None
    parts = Structure(text, key)
    at = text.find('"data":[')
    while at >= 0:
        k = parts.begun(at + 7)
        # Its first item, if that is an object, is what is opened next.
        if k >= 0 and parts.ends[k] and k + 1 in parts.keyed and parts.parents[k + 1] == k and not text[at + 8 : parts.opens[k + 1]].strip():
            try:
                json.loads(parts.value(k))
                return parts.value(k)
            except ValueError:
                pass
        at = text.find('"data":[', at + 8)
    return None


def object_around(parts: Structure, at: int) -> int:
    """The innermost object that holds a place, or -1."""
    k = parts.around(at)
    while k >= 0 and parts.text[parts.opens[k]] != "{":
        k = parts.parents[k]
    return k


def enclosing_object(text: str, mark: str) -> str | None:
    """The innermost object that holds a mark."""
    at = text.find(mark)
    parts = Structure(text) if at >= 0 else None
    return parts.value(object_around(parts, at)) if parts else None


#: Characters on each side of a trade's id in which an address still counts as that trade's.
NEARBY = 500
_ADDRESS = re.compile(r'"filingUrl":"((?:[^"\\]|\\.)*)"')
#: One pattern for all trades: a pattern of each id would be compiled for each row.
_TRADE_ID = re.compile(r'"tradeId":\s*(-?\d+)')


def trade_record(text: str, trade_id: int) -> tuple[str | None, str | None]:
    """(object, address): the first object that is the trade's own by its parsed id; short of that, an address near its id."""
    parts, seen, own = None, set(), str(int(trade_id))
    for m in _TRADE_ID.finditer(text):
        if m[1] != own:
            continue
        parts = parts or Structure(text)
        k = parts.around(m.start())
        if k >= 0 and k not in seen and text[parts.opens[k]] == "{":  # its own key, not that of an object around it
            seen.add(k)
            try:
                record = json.loads(parts.value(k) or "")
            except ValueError:
                record = None
            if isinstance(record, dict) and record.get("tradeId") == trade_id:
                return parts.value(k), None
        address = _ADDRESS.search(text, max(0, m.start() - NEARBY), m.start() + NEARBY)
        if address:
            return None, json.loads(f'"{address[1]}"')
    return None, None


def isolated(text: Column, find, *arguments: str) -> Column:
    """A column of one of the finders above."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else find(t, *arguments) for t in texts], dtype=object)

    return run(text)


def number_after(text: Column, key: str) -> Column:
    return F.regexp_extract(text, f'"{key}":\\D{{0,3}}(\\d+)', 1).try_cast("bigint")


def text_after(text: Column, key: str) -> Column:
    raw = F.regexp_extract(text, f'"{key}":"{_INSIDE}"', 1)
    return F.when(raw != "", F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0)))


def feed_rows(pages: DataFrame, key: str, schema) -> DataFrame:
    """Listing pages to feed records: the data array whose items have the key."""
    from pyspark.sql import types as T

    found = pages.select(isolated(payload(), array_with_key, key).alias("_a"))
    return found.select(F.explode(F.from_json("_a", T.ArrayType(schema))).alias("r")).select("r.*")


def trade_details(pages: DataFrame) -> DataFrame:
    """Detail pages (trade_id, html) to what they say of their trade. Without an object of its own a trade has at most an address that stands near its id."""

    @F.pandas_udf("object string, address string")
    def around(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None or pd.isna(i) else trade_record(t, int(i)) for t, i in zip(texts, ids, strict=True)], columns=["object", "address"], dtype=object)

    rows = pages.withColumn("_o", around(payload(), "trade_id")).withColumn("r", F.from_json("_o.object", S.FEED_TRADE))
    # Two spellings that differ in case only are told apart by path, not by column.
    url = F.coalesce(F.get_json_object("_o.object", "$.filingUrl"), F.get_json_object("_o.object", "$.filingURL"), "_o.address")
    return rows.select("trade_id", "r.price", "r.size", F.col("r.sizeRangeHigh").alias("size_range_high"), F.col("r.sizeRangeLow").alias("size_range_low"), url.alias("filing_url"), F.coalesce("r.asset.assetType", "r.assetType").alias("asset_type"), F.col("r.hasCapitalGains").alias("has_capital_gains"), "r.committees", "r.labels")


#: A card begins with its politician's link; its cells are named by their style and hold a label and a value.
_LINK = r'"href":"/politicians/'
_CELL = "cell--"
_TEXTS = r'"children":"' + _INSIDE + '"'


def _cell(name: str) -> Column:
    """The texts of a card's cell, in order; none where the card has no such cell."""
    found = F.get(F.filter("cells", lambda c: c.startswith(name)), F.lit(0))
    return F.coalesce(F.regexp_extract_all(found, F.lit(_TEXTS), F.lit(1)), F.array().cast("array<string>"))


def _value(name: str) -> Column:
    """The text after a cell's label."""
    return F.get(_cell(name), F.lit(1))


def politician_cards(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cards of listing pages, with the pages' columns of keep. A card that lacks its name, party, state or figures is an error; a page without cards has no rows."""
    from quillstone.functions.scalars import compact_number, whole_number

    parts = pages.select(*keep, F.explode(F.slice(F.split(payload(), _LINK), 2, 1_000_000)).alias("card"))
    parts = parts.select(*keep, "card", F.split("card", _CELL).alias("cells"))
    rows = parts.select(
        *keep, F.regexp_extract("card", r"^([A-Z]\d{6})\"", 1).alias("politician_id"), F.get(_cell("name"), F.lit(0)).alias("name"), F.regexp_extract("card", r"party--(democrat|republican|other)\b", 1).alias("party"),
        F.upper(F.regexp_extract("card", r"us-state-full--([a-z]{2})\b", 1)).alias("state"), whole_number(_value("count-trades")).alias("trades"), whole_number(_value("count-issuers")).alias("issuers"),
        F.coalesce(_value("volume"), F.lit("")).alias("_volume"), _value("last-traded").try_cast("date").alias("last_traded"))
    rows = rows.where("politician_id != ''")
    whole = F.col("name").isNotNull() & (F.col("party") != "") & (F.col("state") != "") & F.col("trades").isNotNull() & F.col("issuers").isNotNull() & (F.col("_volume") != "") & F.col("last_traded").isNotNull()
    checked = rows.withColumn("_ok", F.when(~whole, F.raise_error(F.concat(F.lit("incomplete card: "), "politician_id")).cast("boolean")))
    return checked.where("_ok is null").select(*keep, "politician_id", "name", "party", "state", "trades", "issuers", compact_number("_volume").alias("volume"), "last_traded")


def committee_members(pages: DataFrame) -> DataFrame:
    """Listing pages filtered by committee (committee, html) to distinct memberships (politician_id, committee)."""
    return politician_cards(pages, ("committee",)).select("politician_id", "committee").distinct()


#: Issuers whose pages hold no record; fixed values.
NO_RECORD = (
    (432049, "oh", "us", "Goodyear Tire & Rubber Co", "GT:US", "consumer-discretionary"),
    (2334265, "ma", "us", "TOWN OF HINGHAM MASSACHUSETTS", None, None),
    (2334268, "fl", "us", "JEA WATER AND SEWER SYSTEM REVENUE", None, None),
)


def issuer_details(pages: DataFrame) -> DataFrame:
    """Detail pages (issuer_id, html) to feed records. Of pages without a record the known issuers get a row without counts; any other such page is an error."""
    spark = pages.sparkSession
    known = spark.createDataFrame(NO_RECORD, "issuer_id bigint, state string, country string, name string, ticker string, sector string")
    none = F.lit(0).cast("bigint")
    given = F.struct(
        F.col("issuer_id").alias("_issuerId"), F.col("state").alias("_stateId"), F.lit(None).cast("string").alias("c2iq"), "country", F.col("name").alias("issuerName"), F.col("ticker").alias("issuerTicker"), "sector",
        F.lit(None).cast(S.FEED_ISSUER["performance"].dataType).alias("performance"), F.struct(none.alias("countTrades"), none.alias("countPoliticians"), none.alias("volume"), F.lit(None).cast("date").alias("dateLastTraded")).alias("stats"))
    rows = pages.withColumn("_r", F.from_json(isolated(payload(), value_after, '"issuerData":'), S.FEED_ISSUER)).join(known, "issuer_id", "left")
    found = F.coalesce("_r", F.when(F.col("name").isNotNull(), given.cast(S.FEED_ISSUER)), F.raise_error(F.concat(F.lit("no record of issuer "), F.col("issuer_id").cast("string"))).cast(S.FEED_ISSUER))
    return rows.select(found.alias("r")).select("r.*")


def politician_details(pages: DataFrame) -> DataFrame:
    """Detail pages (politician_id, html) to feed records of politicians; null where a page holds none that can be read."""
    return pages.select("politician_id", F.from_json(isolated(payload(), value_after, '"politician":'), S.FEED_POLITICIAN).alias("politician"))


def eod_prices(issuers: DataFrame) -> DataFrame:
    """Pairs of price and date, in either order, to rows; incomplete ones go."""
    pair = issuers.select(F.col("_issuerId").alias("issuer_id"), F.explode("performance.eodPrices").alias("p"))
    number = F.get(F.filter(F.transform("p", lambda v: v.try_cast("double")), lambda v: v.isNotNull()), F.lit(0))
    day = F.get(F.filter(F.transform("p", lambda v: v.try_cast("date")), lambda v: v.isNotNull()), F.lit(0))
    return pair.select("issuer_id", day.alias("price_date"), number.alias("price")).where("price_date is not null and price is not null")


def read_feed(spark: SparkSession, path: str, schema, field: str = "data") -> DataFrame:
    """Captured responses (one JSON document a file) to the records of their data array. The text is parsed by from_json, for a reader of JSON takes no two names that differ in case only."""
    from pyspark.sql import types as T

    whole = T.StructType([T.StructField(field, T.ArrayType(schema))])
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", whole)[field]).alias("r")).select("r.*")


def trades_of(feed: DataFrame) -> DataFrame:
    """Feed trades as flat rows; parties and types in lower case."""
    # Two spellings that differ in case only are renamed by place, for names can't tell them apart.
    feed = feed.toDF(*["filing_url_2" if c == "filingURL" else c for c in feed.columns])
    return feed.select(
        F.col("_txId").alias("tx_id"), F.col("_politicianId").alias("politician_id"), F.col("_assetId").alias("asset_id"), F.col("_issuerId").alias("issuer_id"), F.col("pubDate").alias("pub_date"),
        F.col("filingDate").alias("filing_date"), F.col("txDate").alias("tx_date"), F.lower("txType").alias("tx_type"), F.col("txTypeExtended").alias("tx_type_extended"), F.col("hasCapitalGains").alias("has_capital_gains"),
        "owner", "chamber", "price", "size", F.col("sizeRangeHigh").alias("size_range_high"), F.col("sizeRangeLow").alias("size_range_low"), "value", F.col("filingId").alias("filing_id"),
        F.coalesce("filingUrl", "filing_url_2").alias("filing_url"), F.col("reportingGap").alias("reporting_gap"), "comment", "committees", "labels", F.coalesce("asset.assetType", "assetType").alias("asset_type"),
        F.coalesce("issuer.issuerTicker", "asset.assetTicker").alias("ticker"), F.lower("politician.party").alias("party"), F.upper("politician._stateId").alias("state"), F.concat_ws(" ", "politician.firstName", "politician.lastName").alias("full_name"),
    )


def donations_of(feed: DataFrame, cycle: int | None) -> DataFrame:
    return feed.select("sub_id", F.col("committee.committee_id").alias("committee_id"), "contributor_name", "contributor_state", "contributor_employer", "contributor_occupation", F.col("contribution_receipt_date").alias("receipt_date"), F.col("contribution_receipt_amount").alias("amount"), F.lit(cycle).cast("int").alias("cycle"))
