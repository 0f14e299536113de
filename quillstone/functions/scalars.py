"""Column functions: formats, tickers, employers, share estimates and small parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import domains as D

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(x: C) -> Column:
    """Blank texts become null; others stay as they are, untrimmed."""
    return F.when(F.trim(_c(x)) != "", _c(x))


def percent_of(part: C, total: C) -> Column:
    return F.coalesce(F.try_divide(_c(part), _c(total)) * 100, F.lit(0.0))


# Share estimates.


def range_middle(low: C, high: C) -> Column:
    """Null unless both bounds are there, in order and not both 0."""
    low, high = _c(low), _c(high)
    return F.when((low <= high) & ~((low == 0) & (high == 0)), (low + high) / 2.0)


def shares_from_range(low: C, high: C, price: C) -> Column:
    """The middle of the range over the price; null without a positive price, or where that times the price leaves the range."""
    price, middle = _c(price), range_middle(low, high)
    shares = F.when(price > 0, middle / price)
    return F.when((shares * price >= _c(low)) & (shares * price <= _c(high)), shares)


def shares_from_value(value: C, price: C) -> Column:
    return F.when((_c(value) > 0) & (_c(price) > 0), _c(value) / _c(price))


def estimated_shares(low: C, high: C, value: C, price: C) -> Column:
    """By range first, by value where that gives none."""
    return F.coalesce(shares_from_range(low, high, price), shares_from_value(value, price))


# Tickers.


def price_ticker(ticker: C) -> Column:
    """The price source's name of a ticker of the feed: $$X is a currency, the last :suffix an exchange, / and . become -."""
    t = F.trim(_c(ticker))
    dashed = lambda x: F.translate(x, "/.", "--")
    base, code = F.trim(F.regexp_extract(t, r"(?s)^(.*):([^:]*)$", 1)), F.upper(F.trim(F.regexp_extract(t, r"(?s)^(.*):([^:]*)$", 2)))
    endings = F.create_map(*[F.lit(x) for pair in D.EXCHANGE_ENDINGS.items() for x in pair])
    listed = F.when(base != "", F.concat(dashed(base), F.coalesce(F.try_element_at(endings, code), F.lit(""))))
    coin = F.when(F.length(t) > 2, F.concat(F.substring(t, 3, 1 << 20), F.lit("-USD")))
    return F.when(t == "", None).when(t.startswith("$$"), coin).when(F.contains(t, F.lit(":")), listed).otherwise(dashed(t))


def exchange_suffix(ticker: C) -> Column:
    """What follows the first colon, or (none)."""
    t = _c(ticker)
    return F.when(F.instr(t, ":") > 0, F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)).otherwise("(none)")


# Employers.


def is_no_employer(employer: C) -> Column:
    pattern = "^(" + "|".join(re.escape(x).replace(r"\-", "-").replace(r"\ ", " ") for x in D.NO_EMPLOYER) + ")"
    return F.lower(F.trim(_c(employer))).rlike(pattern)


def employer_name(raw: C) -> Column:
    """Lower case, one company ending taken off (also where no word begins there), then dots, commas and blanks at the end, and runs of blanks."""
    endings = "|".join(x.replace(".", r"\.") for x in D.COMPANY_ENDINGS)
    name = F.regexp_replace(F.lower(F.trim(_c(raw))), f"({endings})$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[., ]+$", ""), r"\s+", " "))


# Committees.


def committee_class(kind: C, designation: C) -> Column:
    kind, designation = _c(kind), _c(designation)
    return (
        F.when(designation == "D", "leadership_pac")
        .when(designation == "J", "joint_fundraising")
        .when(kind.isin("H", "S", "P"), F.when(designation.isin("A", "P"), "campaign").otherwise("other"))
        .when(kind.isin("X", "Y", "Z"), "party")
        .when(kind.isin("N", "Q", "O"), "pac")
        .otherwise("other")
    )


# Formats.


def _fixed(value: Column, places: int) -> Column:
    """Decimal places as C and Rust print them: halves of the exact binary value to even."""
    return F.replace(F.format_number(value.cast("double"), places), F.lit(","))


def _scaled(value: Column, size: float, mark: str) -> Column:
    return F.concat(F.lit("$"), _fixed(value / size, 1), F.lit(mark))


def format_value(value: C) -> Column:
    v = _c(value)
    return F.when(v >= 1_000_000, _scaled(v, 1e6, "M")).when(v >= 1_000, _scaled(v, 1e3, "K")).otherwise(F.concat(F.lit("$"), v.cast("string")))


def format_large(value: C) -> Column:
    v = _c(value)
    return F.when(v >= 1e12, _scaled(v, 1e12, "T")).when(v >= 1e9, _scaled(v, 1e9, "B")).when(v >= 1e6, _scaled(v, 1e6, "M")).otherwise(F.concat(F.lit("$"), v.cast("string")))


def format_percent(share: C) -> Column:
    """A share of 1, with its sign."""
    v = _c(share)
    return F.concat(F.when(v >= 0, "+").otherwise(""), _fixed(v * 100, 1), F.lit("%"))


def format_shares(x: C) -> Column:
    return _fixed(_c(x), 2)


def format_currency(x: C, commas: bool = False) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(x).cast("double"), 2) if commas else _fixed(_c(x), 2))


def safe_cell(x: C) -> Column:
    """A tab before what a spreadsheet would take for a formula."""
    return F.when(_c(x).rlike(r"^[=+\-@]"), F.concat(F.lit("\t"), _c(x))).otherwise(_c(x))


def party_title(x: C) -> Column:
    return F.initcap(_c(x))


# Small parsers.


def filing_id(url: C) -> Column:
    """The number that names a filing: the last part of the address without query and .pdf, if it is all digits."""
    found = F.regexp_extract(F.substring_index(_c(url), "?", 1), r"(?:^|/)([0-9]+)(?:\.pdf)*$", 1)
    return F.when(found != "", found.try_cast("bigint"))


def whole_number(x: C) -> Column:
    return F.regexp_replace(F.trim(_c(x)), ",", "").try_cast("bigint")


def compact_number(x: C) -> Column:
    """$1.5M and the like, rounded; - and what can't be read are null."""
    clean = F.upper(F.regexp_replace(F.trim(_c(x)), "[$,]", ""))
    scale = F.when(clean.endswith("K"), 1e3).when(clean.endswith("M"), 1e6).when(clean.endswith("B"), 1e9).otherwise(1.0)
    return F.round(F.regexp_replace(clean, "[KMB]$", "").try_cast("double") * scale).cast("bigint")


def last_price(pairs: C) -> Column:
    """The first number of the first pair of an array of pairs, whichever side it is on."""
    first = F.get(_c(pairs), F.lit(0))
    return F.get(F.filter(F.transform(first, lambda v: v.try_cast("double")), lambda v: v.isNotNull()), F.lit(0))
