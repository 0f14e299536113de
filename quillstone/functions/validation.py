"""Checks of what a caller types, before a plan is built: each returns the canonical value or raises ValueError."""

from __future__ import annotations

import datetime as dt
import re

from quillstone.functions import domains as D


def _one(kind: str, text: str, values, short: dict[str, str] | None = None) -> str:
    key = text.strip().lower()
    key = (short or {}).get(key, key)
    if key not in values:
        raise ValueError(f"unknown {kind} '{text}': one of {', '.join(values)}")
    return key


def text(value: str, most_bytes: int) -> str:
    if len(value.encode()) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes")
    clean = re.sub(r"[\x00-\x1f\x7f]", "", value).strip()
    if not clean:
        raise ValueError("empty text")
    return clean


def search(value: str) -> str:
    return text(value, 100)


def state(value: str) -> str:
    code = value.strip().upper()
    if code not in D.STATES:
        raise ValueError(f"unknown state '{value}'")
    return code


def party(value: str) -> str:
    return _one("party", value, D.PARTIES, {"d": "democrat", "r": "republican"})


def chamber(value: str) -> str:
    return _one("chamber", value, D.CHAMBERS, {"h": "house", "s": "senate"})


def gender(value: str) -> str:
    return _one("gender", value, D.GENDERS, {"f": "female", "m": "male"})


def committee(value: str) -> str:
    key = text(value, 80).lower()
    found = key if key in D.COMMITTEES else next((c for c, name in D.COMMITTEES.items() if name.lower() == key), None)
    if not found:
        raise ValueError(f"unknown committee '{value}'")
    return found


def market_cap(value: str) -> str:
    return _one("market cap", value, D.MARKET_CAPS, {str(i): c for i, c in enumerate(D.MARKET_CAPS, 1)})


def asset_type(value: str) -> str:
    return _one("asset type", value, D.ASSET_TYPES)


def label(value: str) -> str:
    return _one("label", value, D.LABELS)


def sector(value: str) -> str:
    return _one("sector", value, D.SECTORS)


def gics_sector(value: str) -> str:
    """The title-case name, whatever the case given."""
    from quillstone.sources.adapters import SECTORS

    names = {s.lower(): s for s, _ in SECTORS}
    return names[_one("GICS sector", value, names)]


def tx_type(value: str) -> str:
    return _one("transaction type", value, D.TX_TYPES)


def _between(kind: str, n: int, least: int, most: int | None = None) -> int:
    if n < least or most is not None and n > most:
        raise ValueError(f"{kind} must be {least}{f' to {most}' if most else ' or more'}")
    return n


def page(n: int) -> int:
    return _between("page", n, 1)


def page_size(n: int) -> int:
    return _between("page size", n, 1, 100)


def days(n: int) -> int:
    return _between("days", n, 1, 3650)


def trade_size(value: str) -> int:
    key = value.strip()
    if not key.isdigit() or str(int(key)) != key:
        raise ValueError(f"unknown trade size '{value}'")
    return _between("trade size", int(key), 1, len(D.TRADE_SIZES))


def politician_id(value: str) -> str:
    key = value.strip()
    if not re.fullmatch(r"[A-Z][0-9]{6}", key):
        raise ValueError(f"'{value}' isn't a letter and six digits")
    return key


def two_letters(value: str) -> str:
    """Countries and states of issuers."""
    key = value.strip()
    if not re.fullmatch(r"[A-Za-z]{2}", key):
        raise ValueError(f"'{value}' isn't two letters")
    return key.lower()


country = issuer_state = two_letters


def date(value: str) -> dt.date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
        raise ValueError(f"'{value}' isn't a date (YYYY-MM-DD)")
    return dt.date.fromisoformat(value.strip())


def relative_days(day: dt.date, as_of: dt.date) -> int | None:
    """Days before as_of; None for a later day."""
    n = (as_of - day).days
    return n if n >= 0 else None


def several(values: str, check) -> tuple:
    """A comma-separated list, each item checked."""
    return tuple(check(v) for v in values.split(",") if v.strip())
