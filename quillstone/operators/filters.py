"""Filter specifications as dataclasses, each turned into one predicate that reaches the scan.

Every multi-valued filter means "any of these". Dates are inclusive at both ends. Parties and types are
compared in lower case, states in upper case; an unset filter adds nothing to the plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Values = tuple[str, ...]


def everything(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def contains(column: Column, text: str) -> Column:
    """Case-insensitive, with % and _ of the text taken literally."""
    safe = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return column.ilike(f"%{safe}%")


def any_of(column: str | Column, values: Values, how=F.lower) -> Column:
    fold = {F.lower: str.lower, F.upper: str.upper}.get(how, lambda x: x)
    column = F.col(column) if isinstance(column, str) else column
    return (how(column) if how else column).isin([fold(v) for v in values])


def day_range(column: str, since: dt.date | None, until: dt.date | None) -> list[Column]:
    """A missing or unreadable date lies in no range."""
    if since and until and since > until:
        raise ValueError(f"since ({since}) is after until ({until})")
    day = F.to_date(column)
    return [day >= F.lit(since)] * bool(since) + [day <= F.lit(until)] * bool(until)


def window_of_days(days: int | None, as_of: dt.date) -> dt.date | None:
    """The first day of the last `days` days."""
    return as_of - dt.timedelta(days=days) if days else None


@dataclass
class TradeFilter:
    party: Values = ()
    state: Values = ()
    tx_type: Values = ()
    chamber: Values = ()
    gender: Values = ()
    sector: Values = ()
    issuer_state: Values = ()
    country: Values = ()
    politician_id: Values = ()
    issuer_id: tuple[int, ...] = ()
    asset_type: Values = ()
    name: str | None = None
    issuer: str | None = None
    since: dt.date | None = None
    until: dt.date | None = None
    tx_since: dt.date | None = None
    tx_until: dt.date | None = None

    def predicate(self) -> Column:
        parts = [any_of(c, getattr(self, c)) for c in ("party", "tx_type", "chamber", "gender", "sector", "issuer_state", "country", "asset_type") if getattr(self, c)]
        parts += [any_of("state", self.state, F.upper)] * bool(self.state)
        parts += [F.col(c).isin(list(getattr(self, c))) for c in ("politician_id", "issuer_id") if getattr(self, c)]
        if self.name:
            parts.append(contains(F.concat_ws(" ", "first_name", "last_name"), self.name))
        if self.issuer:
            parts.append(contains(F.col("issuer_name"), self.issuer) | contains(F.col("ticker"), self.issuer))
        return everything(parts + day_range("pub_date", self.since, self.until) + day_range("tx_date", self.tx_since, self.tx_until))


@dataclass
class PoliticianFilter:
    party: Values = ()
    state: Values = ()
    chamber: Values = ()
    name: str | None = None

    def predicate(self) -> Column:
        parts = [any_of(c, getattr(self, c)) for c in ("party", "chamber") if getattr(self, c)]
        parts += [any_of("state", self.state, F.upper)] * bool(self.state)
        if self.name:
            parts.append(contains(F.concat_ws(" ", "first_name", "last_name"), self.name))
        return everything(parts)


@dataclass
class IssuerFilter:
    search: str | None = None
    sector: Values = ()
    state: Values = ()
    country: Values = ()

    def predicate(self) -> Column:
        parts = [any_of(c, getattr(self, c)) for c in ("sector", "state", "country") if getattr(self, c)]
        if self.search:
            parts.append(contains(F.col("issuer_name"), self.search) | contains(F.col("ticker"), self.search))
        return everything(parts)


@dataclass
class DonationFilter:
    politician_id: str | None = None
    cycle: int | None = None
    min_amount: float | None = None
    employer: str | None = None
    state: str | None = None

    def predicate(self) -> Column:
        parts = [F.col("politician_id") == self.politician_id] * (self.politician_id is not None)
        parts += [F.col("cycle") == self.cycle] * (self.cycle is not None) + [F.col("amount") >= self.min_amount] * (self.min_amount is not None)
        if self.employer:
            parts.append(contains(F.col("contributor_employer"), self.employer))
        if self.state:
            parts.append(F.upper("contributor_state") == self.state.upper())
        return everything(parts)


@dataclass
class PortfolioFilter:
    politician_id: str | None = None
    ticker: str | None = None
    party: Values = ()
    state: Values = ()
    include_closed: bool = False

    #: Fewer shares than this are none.
    LEAST_SHARES = 1e-4

    def apply(self, positions: DataFrame, politicians: DataFrame) -> DataFrame:
        """The politicians are joined only where a filter needs them."""
        parts = [] if self.include_closed else [F.col("shares_held") > self.LEAST_SHARES]
        parts += [F.col(c) == getattr(self, c) for c in ("politician_id", "ticker") if getattr(self, c)]
        out = positions.where(everything(parts))
        if self.party or self.state:
            wanted = politicians.where(PoliticianFilter(party=self.party, state=self.state).predicate()).select("politician_id")
            out = out.join(wanted, "politician_id", "left_semi")
        return out


def period_start(period: str, as_of: str | dt.date) -> Column | None:
    """First sell date of a period: ytd, 1y (365 days), 2y (730 days); None for all."""
    day = F.lit(as_of).cast("date")
    if period == "ytd":
        return F.trunc(day, "year")
    if period in ("1y", "2y"):
        return F.date_sub(day, 365 * int(period[0]))
    if period == "all":
        return None
    raise ValueError(f"unknown period: {period}")
