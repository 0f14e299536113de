"""The engine's queries against their SQL, and its parts against values worked out by hand."""

import datetime as dt
import json
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone import schemas as S
from quillstone.functions import scalars, validation
from quillstone.functions.similarity import Names, jaro_winkler_score, near_pairs
from quillstone.operators import anomaly, conflicts, donations, fifo, filters, matching, merge, metrics, portfolio, pricing, reads
from quillstone.plans import catalog
from quillstone.sources import adapters, exports, pages, seeds
from quillstone.streaming import incremental
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events pages".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v.date() if isinstance(v, dt.datetime) and v.time() == dt.time() else v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("name", ["price_asof_backfill_all", "trades_with_metrics_all"])
def test_query_has_every_trade(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() == catalog.queries()["share_estimates"](spark, SMALL).count()


# FIFO.

TRADE = "tx_id bigint, politician_id string, ticker string, tx_type string, tx_date date, shares double, price double"


def lots(spark, *rows):
    return spark.createDataFrame([(i, "P1", "AA", kind, dt.date(2024, 1, 1) + dt.timedelta(i), float(n), float(p)) for i, (kind, n, p) in enumerate(rows)], TRADE)


@pytest.mark.parametrize(
    "rows,closed,held",
    [
        ([("buy", 10, 5)], [], (10, 5, 0)),
        ([("buy", 10, 5), ("sell", 10, 7)], [(10, 0, 1)], (0, 0, 20)),
        ([("buy", 10, 5), ("sell", 4, 7)], [(4, 0, 1)], (6, 5, 8)),
        ([("buy", 10, 5), ("buy", 10, 6), ("sell", 15, 7)], [(10, 0, 2), (5, 1, 2)], (5, 6, 25)),
        ([("buy", 5, 5), ("sell", 9, 7), ("buy", 3, 2)], [(5, 0, 1)], (3, 2, 10)),
        ([("receive", 5, 5), ("exchange", 5, 9), ("odd", 1, 1), ("sell", 5, 6)], [(5, 0, 3)], (0, 0, 5)),
    ],
)
def test_fifo_by_hand(spark, rows, closed, held):
    t = lots(spark, *rows)
    assert sorted((r.shares, r.buy_tx_id, r.sell_tx_id) for r in fifo.closed_lots(t).collect()) == sorted(closed)
    p = fifo.positions(t).first()
    assert (p.shares_held, p.cost_basis, p.realized_pnl) == pytest.approx(held)


def test_sell_from_nothing_gives_nothing(spark):
    assert fifo.closed_lots(lots(spark, ("sell", 5, 5))).count() == 0


def sequential_lots(trades, keys=fifo.KEYS):
    """The same matches by a queue in order, one group at a time: the semantic reference that tests hold the windows against."""
    kind = {f.name: f.dataType.simpleString() for f in trades.schema}
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + ", shares double, buy_tx_id bigint, sell_tx_id bigint"

    def run(group):
        lots, out = [], []
        for row in group.sort_values(["tx_date", "tx_id"]).itertuples():
            if row.tx_type in ("buy", "receive"):
                lots.append([row.tx_id, row.shares])
            elif row.tx_type == "sell":
                left = row.shares
                while left > fifo.EPSILON and lots:
                    n = min(left, lots[0][1])
                    out.append((*[getattr(row, k) for k in keys], n, lots[0][0], row.tx_id))
                    left -= n
                    lots[0][1] -= n
                    if lots[0][1] < fifo.EPSILON:
                        lots.pop(0)
        return pd.DataFrame(out, columns=[*keys, "shares", "buy_tx_id", "sell_tx_id"])

    return trades.select(*keys, "tx_id", "tx_date", "tx_type", "shares").groupBy(*keys).applyInPandas(run, schema)


def test_windows_match_as_a_queue_does(spark):
    rng = random.Random(6)
    rows = [(i, f"P{rng.randrange(4)}", f"T{rng.randrange(3)}", rng.choice(["buy", "buy", "sell", "receive", "exchange"]), dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60)), rng.randrange(1, 400) / 8, 1.0) for i in range(600)]
    t = spark.createDataFrame(rows, TRADE)
    key = lambda df: sorted((r.politician_id, r.ticker, r.buy_tx_id, r.sell_tx_id, round(r.shares, 6)) for r in df.collect())
    assert key(fifo.closed_lots(t)) == key(sequential_lots(t))


# Metrics, anomalies, conflicts.


def test_returns_and_their_edges(spark):
    row = spark.range(1).select(metrics.absolute_return(F.lit(100.0), F.lit(110.0)).alias("a"), metrics.absolute_return(F.lit(0.0), F.lit(1.0)).alias("z"), metrics.annualized_return(F.lit(10.0), F.lit(365)).alias("y"), metrics.annualized_return(F.lit(10.0), F.lit(29)).alias("s")).first()
    assert row.a == pytest.approx(10) and row.z is None and row.y == pytest.approx(10) and row.s is None


def test_percentiles_run_from_one_to_zero(spark):
    rows = metrics.with_percentile(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "politician_id string, avg_return double")).collect()
    assert {r.politician_id: r.percentile for r in rows} == {"b": 1.0, "a": 0.5, "c": 0.0}
    assert metrics.with_percentile(spark.createDataFrame([("a", 1.0)], "politician_id string, avg_return double")).first().percentile == 1.0


def test_volume_signal_and_concentration(spark):
    day = dt.date(2024, 6, 30)
    rows = [("a", day - dt.timedelta(i)) for i in range(9)] + [("a", day - dt.timedelta(100 + i)) for i in range(8)] + [("b", day)]
    out = {r.politician_id: r for r in anomaly.volume_signals(spark.createDataFrame(rows, "politician_id string, tx_date date"), day).collect()}
    assert out["a"].ratio == pytest.approx(9 / (8 * 90 / 365)) and out["a"].unusual and out["b"].ratio == 0
    hhi = anomaly.sector_concentration(spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("a", None, 9.0), ("b", "x", -1.0)], "politician_id string, gics_sector string, value double")).collect()
    assert len(hhi) == 1 and hhi[0].hhi == pytest.approx(0.625) and hhi[0].dominant_sector == "x" and hhi[0].concentrated


def test_first_jurisdiction_of_a_code_holds(spark):
    j = spark.createDataFrame([(0, "c1", "A"), (3, "c1", "B"), (1, "c2", "C")], "entry int, committee string, sector string")
    out = conflicts.committee_sectors(spark.createDataFrame([("p", "c1"), ("p", "c2"), ("q", "none")], "politician_id string, committee string"), j).collect()
    assert [(r.politician_id, r.sectors) for r in out] == [("p", ["A", "C"])]


# Donations, by the six rows worked out by hand.


def test_donation_roll_ups(spark):
    rows = [("SUB001", "Alice Smith", "Tech Corp", "CA", 500.0), ("SUB002", "Bob Jones", "Finance LLC", "NY", 1000.0), ("SUB003", None, "Unknown Employer", "CA", 250.0), ("SUB004", "Charlie Brown", "Tech Corp", "TX", 750.0), ("SUB005", "Alice Smith", "Tech Corp", "CA", 300.0), ("SUB006", "Diana Prince", "Legal Services", "NY", 100.0)]
    d = spark.createDataFrame([(*r, dt.date(2024, 1, 1)) for r in rows], "sub_id string, contributor_name string, contributor_employer string, contributor_state string, amount double, receipt_date date")
    who = {r.contributor_name: r for r in donations.rolled_up(d, "contributor").collect()}
    assert (who["Alice Smith"].total_amount, who["Alice Smith"].count_donations) == (800, 2) and "Unknown" in who
    firm = {r.contributor_employer: r for r in donations.rolled_up(d, "employer").collect()}["Tech Corp"]
    assert (firm.total_amount, firm.count_donations, firm.count_contributors) == (1550, 3, 2)
    state = {r.contributor_state: r for r in donations.rolled_up(d, "state").collect()}["CA"]
    assert (state.total_amount, state.count_donations, state.count_contributors) == (1050, 3, 1)
    with pytest.raises(ValueError):
        donations.rolled_up(d, "planet")


def gifts_and_bridge(spark):
    """Donations with nulls and repeated ids, a bridge with repeated rows, a committee known twice and one unknown."""
    gifts = [(str(k % 37), f"C{k % 4}", None if k % 5 == 0 else f"D{k % 7}", None if k % 3 == 0 else "CA", [None, "Tech", "tech ", "Acme"][k % 4 if k % 9 else 1], dt.date(2024, 1, 1 + k % 20), None if k % 11 == 0 else k % 13 * 1.37, 2024) for k in range(120)]
    d = spark.createDataFrame(gifts, "sub_id string, committee_id string, contributor_name string, contributor_state string, contributor_employer string, receipt_date date, amount double, cycle int")
    links = spark.createDataFrame([("P1", "C0"), ("P1", "C0"), ("P1", "C1"), ("P2", "C1"), ("P2", "C0"), ("P3", "C2"), ("P9", "C3")], "politician_id string, committee_id string")
    people = spark.createDataFrame([(f"P{k}", f"N{k}", "democrat" if k % 2 else "other", "CA") for k in range(1, 5)], "politician_id string, full_name string, party string, state string")
    known = spark.createDataFrame([("C0", "a", "H", "A"), ("C0", "b", "H", "A"), ("C2", "c", "H", "A")], "committee_id string, name string, committee_type string, designation string")
    return d, links, people, known


def test_donations_are_summed_before_the_bridge_as_they_are_listed(spark):
    d, links, people, known = gifts_and_bridge(spark)
    listed, times = donations.listed(d, links, people, known), donations.counted(donations.reached(links, people), known)
    sorted_rows = lambda df, cols: sorted((tuple(map(plain, r)) for r in df.select(cols).collect()))
    for by in ("contributor", "employer", "state"):
        want = donations.rolled_up(listed, by)
        assert sorted_rows(donations.rolled_up_reached(d, times, by), want.columns) == sorted_rows(want, want.columns)
    want = listed.groupBy("politician_id").agg(donations.money().alias("total_amount"), F.count("*").alias("count_donations"))
    assert sorted_rows(donations.totals(d, donations.counted(donations.reached(links, people), known, "politician_id")), want.columns) == sorted_rows(want, want.columns)
    for limit in (1, 5, 40):
        spec = filters.DonationFilter(min_amount=2.0, politician_id="P1" if limit == 40 else None)
        want = donations.listed(d, links, people, known, spec).orderBy(F.desc("amount"), "sub_id", "politician_id").limit(limit).select("amount", "sub_id", "politician_id")
        assert [tuple(r) for r in donations.listed(d, links, people, known, spec, limit).select(want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_sectors_and_correlation_of_repeated_links_and_ids(spark):
    """A donation's id may come again with another amount or committee; rows that are equal but for the committee count once for a politician of both."""
    d, links, people, _ = gifts_and_bridge(spark)
    matched = d.where("contributor_employer is not null").withColumns({"issuer_ticker": F.lit("T"), "gics_sector": F.when(F.col("contributor_employer") == "Acme", "Energy").otherwise("Tech"), "confidence": F.lit(0.9)})
    trades = spark.createDataFrame([("P1", "T"), ("P1", "T"), ("P2", "T"), ("P3", "X")], "politician_id string, ticker string")
    every = matched.join(links, "committee_id")
    once = {(r.politician_id, r.sub_id, r.amount, r.contributor_employer) for r in every.collect()}
    got = {r.politician_id: r for r in donations.trade_correlation(trades, matched, links, 0.8).collect()}
    assert sorted(got) == ["P1", "P2"]
    for who, r in got.items():
        mine = [x for x in once if x[0] == who]
        assert (r.count_donations, r.count_trades, r.employers) == (len({x[1] for x in mine}), 2 if who == "P1" else 1, ", ".join(sorted({x[3] for x in mine})))
        assert math.isclose(r.total_amount, sum(x[2] or 0 for x in mine))
    want = {(r.politician_id, r.gics_sector): (round(r.t, 6), r.n) for r in every.groupBy("politician_id", "gics_sector").agg(donations.money().alias("t"), F.count_distinct("contributor_employer").alias("n")).collect()}
    assert {(r.politician_id, r.gics_sector): (round(r.total_amount, 6), r.count_employers) for r in donations.sector_summary(matched, links).collect()} == want


def test_trades_of_orders_beyond_23_bits_have_ids_of_their_own(spark):
    top = 1 << 23
    keys = [(k, p, n) for k in (1, top - 1, top, top + 1, top + (1 << 17), 9_000_000, 1 << 33) for p in (1, 7, 1_200_000) for n in (1, 2, 7)]
    rows = [(k, p, n, dt.datetime(1996, 3, day)) for k, p, n in keys for day in (1, 2)]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_shipdate timestamp")
    ids = [(r.l_orderkey, r._tx_id) for r in adapters.numbered(lines).collect()]
    assert len({i for _, i in ids}) == len(rows) and min(i for _, i in ids) >= 0
    assert {(r.l_orderkey, r._tx_id) for r in adapters.numbered(lines.where(f"l_orderkey < {top}")).collect()} == {(r.l_orderkey, r.x) for r in lines.where(f"l_orderkey < {top}").select("l_orderkey", F.expr(adapters._TX_ID).alias("x")).collect()}
    assert sorted(r._tx_id for r in adapters.numbered(lines.repartition(3)).collect()) == sorted(i for _, i in ids)


# Scalars.


@pytest.mark.parametrize("raw,want", [("AAPL:US", "AAPL"), ("BRK/B:US", "BRK-B"), ("$$BTC", "BTC-USD"), ("$$", None), ("", None), ("VOD:LN", "VOD.L"), ("BF.B", "BF-B"), ("  X ", "X"), (":US", None)])
def test_price_tickers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(scalars.price_ticker("t").alias("x")).first().x == want


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) else 'bigint' if isinstance(v, int) else 'double'}" for n, v in zip(names, values, strict=True))).select(column(*names).alias("x")).first().x


def test_small_formats(spark):
    assert one(spark, scalars.format_value, 1_500_000) == "$1.5M" and one(spark, scalars.format_value, 999) == "$999" and one(spark, scalars.format_value, 2_000) == "$2.0K"
    assert one(spark, scalars.format_large, 2_500_000_000_000) == "$2.5T" and one(spark, scalars.format_percent, 0.123) == "+12.3%"
    assert one(spark, scalars.compact_number, "$1.5M") == 1_500_000 and one(spark, scalars.compact_number, "-") is None and one(spark, scalars.compact_number, "2,345") == 2345
    assert one(spark, scalars.safe_cell, "=1+1") == "\t=1+1" and one(spark, scalars.safe_cell, "ok") == "ok"
    assert one(spark, scalars.filing_id, "https://x/1234.pdf?a=1") == 1234 and one(spark, scalars.filing_id, "https://x/ab.pdf") is None
    assert one(spark, scalars.whole_number, "1,234") == 1234 and one(spark, scalars.empty_to_null, "  ") is None


def test_share_estimates(spark):
    assert one(spark, scalars.estimated_shares, 1000, 3000, 5000, 10.0) == 200
    assert one(spark, scalars.estimated_shares, 3000, 1000, 5000, 10.0) == 500
    assert one(spark, scalars.estimated_shares, 0, 0, 0, 10.0) is None and one(spark, scalars.estimated_shares, 1000, 3000, 5000, 0.0) is None


def test_employer_names(spark):
    assert one(spark, scalars.employer_name, " Acme  Widgets, Inc ") == "acme widgets" and one(spark, scalars.employer_name, "Costco") == "cost"
    assert one(spark, scalars.is_no_employer, "Self-Employed") and one(spark, scalars.is_no_employer, " RETIRED ") and not one(spark, scalars.is_no_employer, "Acme")


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert jaro_winkler_score(a, b) == pytest.approx(want, abs=1e-6)


def plain_jaro_winkler(a, b):
    """Letter by letter, as the definition goes."""
    if a == b or not a or not b:
        return float(a == b)
    reach, taken, kept = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == ch), None)
        if j is not None:
            taken.add(j)
            kept.append(ch)
    m = len(kept)
    if not m:
        return 0.0
    s = (m / len(a) + m / len(b) + (m - sum(x != b[j] for x, j in zip(kept, sorted(taken), strict=True)) // 2) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return s + 0.1 * same * (1 - s) if s > 0.7 else s


def made_names(rng, n, letters="etaoinshrdlucmfywgpbvk "):
    words = ["".join(rng.choice(letters[:-1]) for _ in range(rng.randint(2, 9))) for _ in range(max(30, n // 4))]
    return list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)))


def misspelt(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], [out[at], rng.choice("abcxyz7-")], [rng.choice("abcxyzé")], [" ", out[at]]))
        out = out or ["q"]
    return "".join(out)


@pytest.mark.parametrize("threshold,block", [(0.75, 4096), (0.85, 16), (0.95, 50)])
def test_near_names_are_all_that_reach_the_threshold(spark, monkeypatch, threshold, block):
    """Against every pair scored letter by letter; in one block and in many; short, long, repeated, empty and null names."""
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(5)
    right = [*made_names(rng, 150), "a", "ab", "é", "7", "aaaaaaaaaaaa", "x" * 700, None, ""]
    left = sorted({misspelt(rng, b) for b in right if b for _ in range(2)}) + ["", "a", "b", "ba", "aaaaaaa", "x" * 650 + "y" * 50]
    as_table = lambda names, c: spark.createDataFrame([(x,) for x in [*names, names[0], None]], f"{c} string")
    got = {(r.a, r.b): r.score for r in matching.near_names(as_table(left, "a"), as_table(right, "b"), threshold).collect()}
    near = {(a, b): s for a in left for b in right if a and b and (s := plain_jaro_winkler(a, b)) >= threshold}
    assert got == pytest.approx(near, abs=1e-12) and len(near) > 100


def test_few_pairs_of_names_are_formed():
    """At 3,000 x 3,000 distinct names under a twentieth of all pairs, and all that count."""
    rng = random.Random(11)
    right = made_names(rng, 3000)
    left = list(dict.fromkeys(misspelt(rng, b) for b in right))
    a, b = Names.of(left), Names.of(right)
    i, j, _, scored = near_pairs(a, b, matching.THRESHOLD)
    assert scored < 0.05 * len(left) * len(right)
    some = rng.sample(range(len(left)), 40)
    near = {(x, y) for x in some for y in range(len(right)) if plain_jaro_winkler(left[x], right[y]) >= matching.THRESHOLD}
    assert near == {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x in set(some)} and near


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_stretches_of_a_key_give_the_rows_of_one_run(spark, most):
    """One key with all trades, many on a day and at equal ends, sells beyond what is held; and a small key beside it."""
    rng = random.Random(most)
    rows = [(i, "P1" if i % 9 else "P2", "AA", rng.choice(("buy", "sell", "sell", "receive", "exchange")), dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40)), float(rng.randint(1, 6)), float(i)) for i in range(400)]
    trades = spark.createDataFrame(rows, TRADE)
    flat = lambda df: sorted((r.politician_id, r.buy.tx_id, r.sell.tx_id if r.sell else -1, round(r.shares, 6)) for r in df.collect())
    assert flat(fifo.slices(trades, most=most)) == flat(fifo.slices(trades))
    parts = fifo._stretches(trades, fifo.KEYS, F.datediff("tx_date", F.lit("1970-01-01")).cast("double"), most).groupBy("politician_id").agg(F.countDistinct("_part").alias("n")).collect()
    assert max(r.n for r in parts) == {1: 40, 7: 40, 100_000: 1}[most]


def test_near_names_of_nothing(spark):
    names = spark.createDataFrame([("alpha beta",)], "a string")
    assert matching.near_names(names, spark.createDataFrame([], "b string"), 0.85).count() == 0
    assert matching.near_names(names, spark.createDataFrame([("x" * 300,)], "b string"), 0.85).count() == 0


def test_validators():
    assert validation.party("D") == "democrat" and validation.state(" ca ") == "CA" and validation.days(3650) == 3650 and validation.politician_id("P000197") == "P000197"
    assert validation.several("buy,sell", validation.tx_type) == ("buy", "sell") and validation.date("2024-02-29") == dt.date(2024, 2, 29) and validation.trade_size("3") == 3
    for check, bad in ((validation.party, "x"), (validation.state, "ZZ"), (validation.days, 0), (validation.page_size, 101), (validation.politician_id, "p000197"), (validation.date, "2024-2-1"), (validation.date, "2023-02-29"), (validation.search, "x" * 101), (validation.trade_size, "03"), (validation.country, "usa")):
        with pytest.raises(ValueError):
            check(bad)
    assert validation.relative_days(dt.date(2024, 1, 1), dt.date(2024, 1, 11)) == 10 and validation.relative_days(dt.date(2025, 1, 1), dt.date(2024, 1, 1)) is None


def test_filters(spark):
    rows = spark.createDataFrame([("a_b", dt.date(2024, 1, 5)), ("axb", dt.date(2024, 1, 6)), ("c", None)], "t string, d date")
    assert [r.t for r in rows.where(filters.contains(F.col("t"), "A_B")).collect()] == ["a_b"]
    assert rows.where(filters.everything(filters.day_range("d", dt.date(2024, 1, 5), dt.date(2024, 1, 5)))).count() == 1
    with pytest.raises(ValueError):
        filters.day_range("d", dt.date(2024, 1, 2), dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        filters.period_start("3y", "2024-01-01")


# Merges, prices, matching.


def test_trade_merge_rules(spark):
    cols = "tx_id bigint, asset_type string, value bigint, comment string, current_price double, has_capital_gains boolean, filing_url string"
    stored = spark.createDataFrame([(1, "stock", 5, "kept", 9.0, True, "u1"), (2, "unknown", 6, None, None, None, "u2")], cols)
    coming = spark.createDataFrame([(1, "unknown", 7, None, 1.0, False, ""), (2, "stock", 8, "new", 1.0, None, "u3"), (3, "unknown", 1, None, 4.0, None, "")], cols)
    out = {r.tx_id: tuple(r)[1:] for r in merge.upsert_trades(stored, coming).collect()}
    assert out[1] == ("stock", 7, "kept", 9.0, True, "u1") and out[2] == ("stock", 8, "new", None, None, "u3") and out[3][:3] == ("unknown", 1, None)


def test_donations_are_inserted_once_and_cursors_accumulate(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sub_id string, amount double")
    more = spark.createDataFrame([("b", 9.0), ("c", 3.0), ("c", 3.0), (None, 4.0)], "sub_id string, amount double")
    assert sorted((r.sub_id, r.amount) for r in merge.insert_donations(d, more).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    cols = "politician_id string, committee_id string, cycle int, last_index bigint, last_synced timestamp, total_synced bigint"
    c = spark.createDataFrame([("p", "c", None, 5, None, 10)], cols)
    moved = merge.save_cursors(c, spark.createDataFrame([("p", "c", None, 9, None, 7)], cols)).collect()
    assert [(r.last_index, r.total_synced) for r in moved] == [(9, 17)]
    done = merge.complete_cursors(c, c, "2024-01-01 00:00:00")
    assert merge.open_cursors(done).count() == 0 and merge.due(done, "2024-01-01 12:00:00").count() == 0 and merge.due(done, "2024-01-02 12:00:00").count() == 1


def test_as_of_prices_look_back_a_week(spark):
    prices = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 5), 5.0)], "ticker string, price_date date, price double")
    wanted = spark.createDataFrame([("A", dt.date(2024, 1, 4)), ("A", dt.date(2024, 1, 12)), ("A", dt.date(2024, 1, 13)), ("B", dt.date(2024, 1, 4))], "ticker string, tx_date date")
    assert {(r.ticker, r.tx_date.day): r.asof_price for r in pricing.as_of_prices(wanted, prices).collect()} == {("A", 4): 1.0, ("A", 12): 5.0, ("A", 13): None, ("B", 4): None}


def test_names_meet_their_identities(spark):
    people = spark.createDataFrame([("P1", "Doe", "CA"), ("P2", "Roe", "NY"), ("P3", "Roe", "NY")], "politician_id string, last_name string, state string")
    leg = spark.sql("select struct('B1' as bioguide, array('H1', 'S1') as fec) as id, struct('DOE' as last) as name, array(struct('TX' as state), struct('ca' as state)) as terms union all select struct('B2', array('H2')), struct('Roe'), array(struct('ny'))")
    assert sorted((r.politician_id, r.fec_candidate_id) for r in matching.match_legislators(leg, people).collect()) == [("P1", "H1"), ("P1", "S1")]
    tickers = matching.resolve_tickers(spark.createDataFrame([("A",), ("B",), ("Z",)], "ticker string"), spark.createDataFrame([("A",), ("B:LN",), ("B:US",)], "ticker string"))
    assert {r.ticker: r.issuer_ticker for r in tickers.collect()} == {"A": "A", "B": "B:LN", "Z": None}


def test_portfolio_values(spark):
    p = spark.createDataFrame([("p", "A", 10.0, 5.0), ("p", "B", 10.0, 0.0), ("p", "C", 1.0, 1.0)], "politician_id string, ticker string, shares_held double, cost_basis double")
    out = {r.ticker: (r.unrealized_pnl, r.unrealized_pct) for r in portfolio.valued(p, spark.createDataFrame([("A", 6.0), ("B", 2.0)], "ticker string, current_price double")).collect()}
    assert out == {"A": (10.0, 20.0), "B": (20.0, 0.0), "C": (None, None)}


def test_points_and_newest(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    assert reads.point(d, k=None).first().n == 3 and {r.n for r in reads.newest_per(d, ["k"], ["n"]).collect()} == {2, 3}


# Pages and streams.


def test_page_payloads(spark):
    body = '{\\"data\\":[{\\"_txId\\":7,\\"txType\\":\\"BUY\\",\\"comment\\":\\"a ] b\\"}]}'
    html = f'<script>self.__next_f.push([1,"1:"])</script><script>self.__next_f.push([1,"{body}"])</script>'
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "html string")
    rows = pages.feed_rows(df, "_txId", spark.createDataFrame([], "_txId bigint, txType string, comment string").schema).collect()
    assert [tuple(r) for r in rows] == [(7, "BUY", "a ] b")]
    assert pages.value_at('[1,"]",[2]] tail', 0) == '[1,"]",[2]]' and pages.value_at("[1", 0) is None
    assert pages.enclosing_object('{"a":{"tradeId":5,"b":1}}', '"tradeId":5') == '{"tradeId":5,"b":1}'


def test_structure_of_odd_texts():
    stray = '1:T9,a " stray [ quote }\n2:{"data":[ {"_txId":7,"note":"] \\" }"}],"next":[1]}\n'
    assert json.loads(pages.array_with_key(stray, "_txId")) == [{"_txId": 7, "note": '] " }'}]
    assert pages.array_with_key('{"data":[{"inner":{"_txId":1}}]}', "_txId") is None  # not a key of the item itself
    assert pages.array_with_key('{"data":[{"a":[{"_txId":1}]}],"more":{"data":[{"_txId":2}]}}', "_txId") == '[{"_txId":2}]'
    assert pages.array_with_key('{"data":[],"x":{"data":[{"_txId":bad}]},"y":{"data":[{"_txId":3}]}}', "_txId") == '[{"_txId":3}]'
    assert pages.array_with_key('{"data":[{"_txId":1}', "_txId") is None and pages.array_with_key("", "_txId") is None
    assert pages.value_at('{"a":"é [","b":[{}]}x', 0) == '{"a":"é [","b":[{}]}' and pages.value_at("x", 0) is None
    assert pages.trade_record('{"a":{"tradeId":5,"b":{"c":1},"d":2},"tradeId":6}', 6) == ('{"a":{"tradeId":5,"b":{"c":1},"d":2},"tradeId":6}', None)
    assert pages.enclosing_object('{"a":[1,{"b":2},"mark"]}', '"mark"') == '{"a":[1,{"b":2},"mark"]}'


@pytest.mark.parametrize("make", [lambda n: '{"data":[{"x":' * n + "1" + "}]}" * n, lambda n: '{"data":[{"tradeId":12,"y":[' + '{"tradeId":12,"z":' * n + "0" + "}" * n + "]}]}", lambda n: '"' + "[{" * n])
def test_time_of_pages_is_linear_in_their_length(make):
    """Deeply nested candidates: eight times the text takes well under the square of that."""
    import time

    def took(n):
        text, began = make(n), time.process_time()
        assert pages.array_with_key(text, "_txId") is None
        pages.enclosing_object(text, "0")
        pages.trade_record(text, 99)
        return time.process_time() - began

    small = max(took(20_000), 0.02)
    assert took(160_000) < 24 * small


def pushed(body):
    return f'<script>self.__next_f.push([1,{json.dumps(body)}])</script>'


def test_feed_files_become_flat_trades(spark, tmp_path):
    """Both spellings of the address, nested names, and records that lack most fields."""
    rows = [{"_txId": 1, "txType": "BUY", "filingURL": "http://x/1", "value": 7, "issuer": {"issuerTicker": "AA:US"}, "politician": {"firstName": "Ann", "lastName": "Lee", "party": "Other", "_stateId": "ca"}}, {"_txId": 2, "filingUrl": "http://x/2", "asset": {"assetType": "stock", "assetTicker": "BB"}}]
    (tmp_path / "a.json").write_text(json.dumps({"meta": {}, "data": rows}, indent=1))
    got = pages.trades_of(pages.read_feed(spark, str(tmp_path), S.FEED_TRADE)).orderBy("tx_id").collect()
    assert [(r.tx_id, r.tx_type, r.filing_url, r.ticker, r.party, r.state, r.full_name, r.asset_type) for r in got] == [(1, "buy", "http://x/1", "AA:US", "other", "CA", "Ann Lee", None), (2, None, "http://x/2", "BB", None, None, "", "stock")]


def test_trade_details_take_the_trades_own_record(spark):
    """An id that begins another's, two trades with addresses of their own, and addresses near or far from an id."""
    both = '{"rows":[{"tradeId":123,"price":9.5,"filingUrl":"http://x/123.pdf"},{"tradeId":12,"price":1.5,"filingUrl":"http://x/12.pdf","asset":{"assetType":"stock"}}]}'
    near = 'x "tradeId":12, "filingUrl":"http://x/near.pdf" ' + "y" * 2000 + ' "filingUrl":"http://x/far.pdf"'
    far = '"filingUrl":"http://x/other.pdf"' + " " * 2000 + '"tradeId":12 ' + " " * 600 + '"filingUrl":"http://x/far.pdf"'
    outer = '{"tradeId":99,"filingUrl":"http://x/99.pdf","inner":{"note":{"tradeId":12}}}' + "z" * 600
    rows = [(12, pushed(both)), (123, pushed(both)), (12, pushed(near)), (12, pushed(far)), (7, pushed(both)), (12, "<p>none</p>"), (12, None), (None, pushed(both))]
    got = pages.trade_details(spark.createDataFrame(rows, "trade_id bigint, html string")).collect()
    assert [(r.price, r.filing_url) for r in got] == [(1.5, "http://x/12.pdf"), (9.5, "http://x/123.pdf"), (None, "http://x/near.pdf"), (None, None), (None, None), (None, None), (None, None), (None, None)]
    assert got[0].asset_type == "stock"
    assert pages.trade_record(outer, 99)[0].startswith('{"tradeId":99') and pages.trade_record(outer, 12)[0] == '{"tradeId":12}'


def card(key="P000197", name="Ann O'Hara", trades=("Trades", "1,234"), volume="$1.5M", day="2024-05-01", issuers=True):
    text = lambda t: '{"children":"' + t + '"}'
    cell = lambda kind, *ts: f'["$","div",null,{{"className":"q-cell cell--{kind}","children":[{",".join(text(t) for t in ts)}]}}]'
    cells = [cell("name", name), '{"className":"party--democrat"}', '{"className":"us-state-full--ca"}', cell("count-trades", *trades)]
    cells += [cell("count-issuers", "Issuer", "7")] if issuers else []
    return f'["$","a",null,{{"href":"/politicians/{key}","children":[{",".join([*cells, cell("volume", "Volume", volume), cell("last-traded", "Last Traded", day)])}]}}]'


def test_politician_cards(spark):
    """Two cards, singular labels, a page without cards, and a card that lacks a cell."""
    df = lambda *bodies: spark.createDataFrame([(pushed(b),) for b in bodies], "html string")
    page = card() + "," + card("S000033", "Bo Li", ("Trade", "1"), "-", "2023-01-02")
    got = [tuple(r) for r in pages.politician_cards(df(page, "no cards")).collect()]
    assert got == [("P000197", "Ann O'Hara", "democrat", "CA", 1234, 7, 1500000, dt.date(2024, 5, 1)), ("S000033", "Bo Li", "democrat", "CA", 1, 7, None, dt.date(2023, 1, 2))]
    with pytest.raises(Exception, match="incomplete card: P000197"):
        pages.politician_cards(df(card(issuers=False))).collect()


def test_issuer_and_politician_details(spark):
    record = '{"issuerData":{"_issuerId":7,"issuerName":"Acme","issuerTicker":"A:US","stats":{"countTrades":3}}} tail'
    df = spark.createDataFrame([(7, pushed(record)), (432049, pushed("nothing"))], "issuer_id bigint, html string")
    rows = {r._issuerId: r for r in pages.issuer_details(df).collect()}
    assert rows[7].issuerName == "Acme" and rows[7].stats.countTrades == 3 and rows[432049].issuerTicker == "GT:US" and rows[432049].stats.volume == 0
    with pytest.raises(Exception, match="no record of issuer 8"):
        pages.issuer_details(spark.createDataFrame([(8, pushed("nothing"))], df.schema)).collect()
    people = spark.createDataFrame([("P1", pushed('{"politician":{"firstName":"Ann","lastName":"Lee"}}')), ("P2", pushed('{"politician":{"firstName":')), ("P3", None)], "politician_id string, html string")
    got = {r.politician_id: r.politician for r in pages.politician_details(people).collect()}
    assert got["P1"].firstName == "Ann" and got["P2"] is None and got["P3"] is None


def test_committee_listings_and_a_round_of_synchronisation(spark):
    listing = spark.createDataFrame([("hsag", pushed(card() + "," + card("S000033"))), ("ssbk", pushed(card())), ("ssbk", pushed(card())), ("hsba", pushed("none"))], "committee string, html string")
    members = pages.committee_members(listing)
    assert sorted(tuple(r) for r in members.collect()) == [("P000197", "hsag"), ("P000197", "ssbk"), ("S000033", "hsag")]
    people = spark.createDataFrame([("P000197", "Ann", None)], "politician_id string, full_name string, enriched_at timestamp")
    issuers = spark.createDataFrame([(1, "Acme", None)], "issuer_id bigint, issuer_name string, enriched_at timestamp")
    trades = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5)], "tx_id bigint, pub_date date, value bigint")
    coming = spark.createDataFrame([(2, dt.date(2024, 1, 2), 6), (3, dt.date(2024, 1, 1), 7)], trades.schema)
    tables = {"trades": trades, "politicians": people, "issuers": issuers, "politician_committees": members.limit(0)}
    out = merge.synced(tables, coming, people, issuers.withColumn("issuer_name", F.lit("Acme Inc")), members, "2024-01-02")
    assert sorted(r.tx_id for r in out["trades"].collect()) == [1, 2] and out["issuers"].first().issuer_name == "Acme Inc"
    assert sorted(r.committee for r in out["politician_committees"].collect()) == ["hsag", "ssbk"]
    again = merge.synced(out, coming, people, issuers, members, "2024-01-02")
    assert sorted(r.tx_id for r in again["trades"].collect()) == [1, 2]


# Tables kept by hand, and exports.


def test_seed_files_are_checked(spark):
    ok = seeds.sector_mappings(spark, "mappings:\n- {ticker: A, sector: energy}\n- {ticker: B, sector: Health Care}").collect()
    assert [tuple(r) for r in ok] == [("A", "Energy"), ("B", "Health Care")]
    with pytest.raises(ValueError, match="repeated ticker: A"):
        seeds.sector_mappings(spark, "mappings:\n- {ticker: A, sector: energy}\n- {ticker: A, sector: energy}")
    with pytest.raises(ValueError):
        seeds.sector_mappings(spark, "mappings:\n- {ticker: A, sector: Farming}")
    with pytest.raises(ValueError, match="no list"):
        seeds.sector_mappings(spark, "")
    with pytest.raises(ValueError, match="chamber of hsag: Lords"):
        seeds.jurisdictions(spark, "committees:\n- {committee_name: hsag, chamber: Lords, sectors: [Energy]}")
    with pytest.raises(ValueError, match="repeated alias: X"):
        seeds.ticker_aliases(spark, "aliases:\n- {from: X, to: ~}\n- {from: X, to: Y}")
    assert [tuple(r) for r in seeds.ticker_aliases(spark, "aliases:\n- {from: X, to: ~}").collect()] == [("X", None)]


def test_employers_of_files_and_reviews_round_trip(spark, tmp_path):
    issuers = spark.createDataFrame([(1, "Acme Widgets Inc", "ACME:US"), (2, "Globex", "GBX"), (3, "=Odd Corporation", "ODD")], "issuer_id bigint, issuer_name string, ticker string")
    text = '[[mapping]]\nemployer_names = ["Acme Widgets", "ACME Widgets LLC"]\nissuer_ticker = "ACME"\nsector = "industrials"\n[[mapping]]\nemployer_names = ["Nobody"]\nissuer_ticker = "NONE"\nsector = "Energy"\n'
    mappings, lookups = seeds.seeded_employers(seeds.employer_seeds(spark, text), issuers)
    assert [tuple(r) for r in mappings.collect()] == [("acme widgets", "ACME:US", 1.0, "exact")]
    assert sorted(r.raw_employer_lower for r in lookups.collect()) == ["acme widgets", "acme widgets llc"]
    unmatched = spark.createDataFrame([("Acme Widget Co",), ("=Odd Corporation",), ("Retired",), ("Something Else Entirely",)], "contributor_employer string")
    review = exports.employers_for_review(unmatched, issuers, 0.85)
    rows = {r.employer: r for r in review.collect()}
    assert set(rows) == {"Acme Widget Co", "\t=Odd Corporation", "Something Else Entirely"}
    assert rows["Acme Widget Co"].suggestion_ticker == "ACME:US" and rows["Acme Widget Co"].confidence == "0.98" and rows["Something Else Entirely"].suggestion_ticker == ""
    confirmed = review.withColumn("confirmed_ticker", F.when(F.col("employer").startswith("Acme"), "ACME").when(F.col("employer").startswith("Some"), "NOPE").otherwise(""))
    confirmed.coalesce(1).write.option("header", True).csv(f"{tmp_path}/review")
    mappings, lookups = seeds.confirmed_employers(spark, f"{tmp_path}/review", issuers)
    assert [tuple(r) for r in mappings.collect()] == [("acme widget", "ACME:US", 1.0, "manual")]
    assert [tuple(r) for r in lookups.collect()] == [("acme widget co", "acme widget")]
    with pytest.raises(ValueError):
        exports.employers_for_review(unmatched, issuers, 1.5)


def test_legislators_of_two_files(spark):
    now = "- id: {bioguide: B1, fec: [H1, S1]}\n  name: {first: Ann, last: Lee}\n  terms: [{type: rep, state: NY}, {type: sen, state: CA, party: Other}]\n"
    people = seeds.legislators(spark, now, now.replace("B1", "B2").replace("Lee", "Poe"))
    politicians = spark.createDataFrame([("P1", "lee", "ca"), ("P2", "poe", "ny")], "politician_id string, last_name string, state string")
    assert sorted(tuple(r) for r in matching.match_legislators(people, politicians).collect()) == [("P1", "B1", "H1"), ("P1", "B1", "S1")]


def test_exports(spark):
    df = spark.createDataFrame([(1, "a|b\nc", ["x", None], (None, "<&>")), (2, None, None, None)], "id int, `name` string, labels array<string>, deep struct<n:int,t:string>")
    assert [r.line for r in exports.markdown_rows(df.select("id", "name")).collect()] == ["| 1 | a\\|b c |", "| 2 |  |"]
    assert exports.markdown_head(df.select("id", "name")) == ["| id | name |", "| --- | --- |"]
    assert [r.line for r in exports.xml_rows(df, "row").collect()] == ["<row><id>1</id><name>a|b\nc</name><labels><label>x</label></labels><deep><t>&lt;&amp;&gt;</t></deep></row>", "<row><id>2</id></row>"]
    assert [r.s for r in exports.safe_csv(spark.createDataFrame([("=1",), ("+1",), ("-1",), ("@a",), ("a=1",), (None,)], "s string")).collect()] == ["\t=1", "\t+1", "\t-1", "\t@a", "a=1", None]


def test_feed_schemas_hold_what_the_contracts_require(spark):
    """Required fields of the feed's records, by name and type."""
    need = {"FEED_TRADE": {"_txId": "bigint", "_politicianId": "string", "_issuerId": "bigint", "pubDate": "timestamp", "txDate": "date", "txType": "string", "owner": "string", "chamber": "string", "value": "bigint", "reportingGap": "bigint", "committees": "array<string>", "labels": "array<string>"}}
    for name, fields in need.items():
        have = {f.name: f.dataType.simpleString() for f in getattr(S, name).fields}
        assert fields.items() <= have.items()


def test_merge_rules_of_single_tables(spark):
    at = "2024-05-01 00:00:00"
    mappings = spark.createDataFrame([("P1", "H1", "B1", ["C1"], 2022, None)], "politician_id string, fec_candidate_id string, bioguide_id string, committee_ids array<string>, election_cycle int, last_synced timestamp")
    found = spark.createDataFrame([("P1", "H1", "B9"), ("P2", "S2", "B2")], "politician_id string, fec_candidate_id string, bioguide_id string")
    got = {r.politician_id: r for r in merge.upsert_mappings(mappings, found, 2024, at).collect()}
    assert got["P1"].bioguide_id == "B9" and got["P1"].committee_ids == ["C1"] and got["P2"].election_cycle == 2024
    again = {r.politician_id: r.committee_ids for r in merge.update_committees(merge.upsert_mappings(mappings, found, 2024, at), "P2", ["C7", "C8"], at).collect()}
    assert again == {"P1": ["C1"], "P2": ["C7", "C8"]}
    trades = spark.createDataFrame([(1, "A", 1.0, 5.0, None), (2, "B", 2.0, None, None)], "tx_id bigint, ticker string, current_price double, benchmark_price double, price_enriched_at timestamp")
    assert [(r.current_price, r.price_enriched_at is None) for r in merge.update_current_prices(trades, spark.createDataFrame([("A", None)], "ticker string, price double"), at).orderBy("tx_id").collect()] == [(None, False), (2.0, True)]
    assert [r.benchmark_price for r in merge.update_benchmark_prices(trades, spark.createDataFrame([(1, None), (2, 3.0), (9, 1.0)], "tx_id bigint, benchmark_price double")).orderBy("tx_id").collect()] == [None, 3.0]
    stats = spark.createDataFrame([("P1", 3, 9)], "politician_id string, count_trades bigint, volume bigint")
    assert sorted(tuple(r) for r in merge.upsert_stats(stats, spark.createDataFrame([("P1", 4, None), ("P2", 1, 1)], stats.schema), "politician_id").collect()) == [("P1", 4, None), ("P2", 1, 1)]
    committees = spark.createDataFrame([("C1", "Old", "[2020]")], "committee_id string, name string, cycles string")
    assert [tuple(r) for r in merge.upsert_fec_committees(committees, spark.createDataFrame([("C1", "New", [2022, 2024])], "committee_id string, name string, cycles array<int>")).collect()] == [("C1", "New", "[2022,2024]")]
    stored = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "issuer_id bigint, mcap double, trailing1 double")
    feed = spark.createDataFrame([(1, (10.0, 20.0)), (2, (30.0, None)), (4, None)], "_issuerId bigint, performance struct<mcap:double,trailing1:double>")
    assert sorted(tuple(r) for r in merge.replace_performance(stored, feed, ("mcap", "trailing1")).collect()) == [(1, 10.0, 20.0), (3, 5.0, 6.0)]
    issuers = spark.createDataFrame([(1, "A", "ca", None)], "issuer_id bigint, issuer_name string, state string, enriched_at timestamp")
    assert [tuple(r)[:3] for r in merge.update_issuer_details(issuers, spark.createDataFrame([(1, None, "ny"), (5, "Z", None)], "issuer_id bigint, issuer_name string, state string"), at).collect()] == [(1, "A", "ny")]


def test_streams_write_each_row_once(spark):
    assert incremental.stream_incremental_ingest(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").distinct().count()
    out = incremental.stream_volume_window(spark, SMALL)
    assert out.count() > 0 and out.where("n <= 0").count() == 0


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "rank" in __spark_entry__.entry(spark).columns


def test_report_reads_trades_once_and_counts_none(spark, tmp_path):
    rows = [("stock", None, None, None, None, None)] + [(k, t, dt.date(2000, 1, 1) if n % 4 else None, 1.0 if n % 3 else None, 2.0 if n % 5 == 0 else None, dt.date(2000, 1, 2) if n % 7 else None) for n, (k, t) in enumerate((k, t) for k in ("stock", None) for t in (None, "", *(f"T{i:02d}" for i in range(40))))]
    trades = spark.createDataFrame(rows, "asset_type string, ticker string, tx_date date, price double, current_price double, price_enriched_at date")
    trades.write.parquet(str(tmp_path / "t"))
    trades = spark.read.parquet(str(tmp_path / "t"))
    out, found = pricing.report(trades), pricing.diagnostics(trades)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = sorted(map(str, (tuple(r)[:3] for r in out.collect())))
    totals = found["totals"].first()
    want = [("trades", c, totals[c]) for c in ("total", "tried", "priced", "failed")] + [("priced of tried", r.asset_type, r.priced) for r in found["asset_types"].collect()]
    want += [("reasons", r.reason, r.n) for r in found["reasons"].collect()]
    assert [x for x in got if "'tickers'" not in x] == sorted(map(str, want)) and sum("'tickers'" in x for x in got) == 30
    assert {(r.item, r.n, r.pct) for r in pricing.report(trades.where("false")).collect()} == {(c, 0, None) for c in ("total", "tried", "priced", "failed")}


def test_trade_record_compiles_no_pattern_for_an_id(monkeypatch):
    """A pattern of each id was compiled for each row; ids are told apart as before."""
    def compiled(*_):
        raise AssertionError("a pattern for one id")

    monkeypatch.setattr(pages.re, "finditer", compiled)
    text = '{"tradeId":55},{"tradeId":05},{"tradeId": -5},{"tradeId":\n5,"size":1}'
    assert pages.trade_record(text, 5) == ('{"tradeId":\n5,"size":1}', None)
    assert pages.trade_record(text, 55) == ('{"tradeId":55}', None) and pages.trade_record(text, -5) == ('{"tradeId": -5}', None)
    assert pages.trade_record(text, 50) == (None, None)


def test_composite_reads_the_trades_once(spark):
    """The joins of trades with orders and parts were run ten times over, and their exchanges filled the disk."""
    found = catalog.queries()["anomaly_composite"](spark, SMALL)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 6


def test_composite_knows_everyone_of_any_part(spark):
    moves = spark.createDataFrame([("P1", 20), ("P3", 5), (None, 5)], "politician_id string, pre_moves bigint")
    volumes = spark.createDataFrame([("P1", 5.0), ("P2", 2.5)], "politician_id string, ratio double")
    hhi = spark.createDataFrame([("P4", 0.3)], "politician_id string, hhi double")
    out = {r.politician_id: r for r in anomaly.composite_scores(moves, volumes, hhi).collect()}
    assert {k: (r.pre_moves, r.ratio, r.hhi) for k, r in out.items()} == {"P1": (20, 5.0, 0.0), "P2": (0, 2.5, 0.0), "P3": (5, 0.0, 0.0), "P4": (0, 0.0, 0.3), None: (0, 0.0, 0.0)}
    assert out["P1"].score == pytest.approx(2 / 3) and out["P2"].confidence == pytest.approx(1 / 3) and out[None].score == 0
