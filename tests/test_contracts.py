"""Contracts from files with passing and failing rows, records decoded with a quarantine, versions of tables."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import types as T

from quillstone.operators import versions
from quillstone.sources import contracts

HERE = pathlib.Path(__file__).parent / "contracts"


@pytest.mark.parametrize("name", ["politician", "trade"])
def test_rows_break_what_their_contract_says(spark, name):
    file = HERE / f"{name}.schema.json"
    contract = contracts.Contract(file.read_text() if file.exists() else contracts.TRADE)
    rows = json.loads((HERE / f"{name}.rows.json").read_text())
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(rows)], "k bigint, text string")
    got = {r.k: r for r in contracts.checked(df, contract, "text").collect()}
    assert [sorted(got[k].errors) for k in range(len(rows))] == [want for _, want in rows]
    assert [got[k].record is None for k in range(len(rows))] == [bool(want) for _, want in rows]


def test_types_of_a_contract():
    kind = contracts.Contract((HERE / "politician.schema.json").read_text()).spark_type()
    assert kind["id"].dataType == T.StringType() and kind["born"].dataType == T.DateType() and kind["committees"].dataType == T.ArrayType(T.StringType())
    assert kind["district"].dataType == T.StringType() and kind["stats"].dataType["last"].dataType == T.TimestampType() and kind["stats"].dataType["share"].dataType == T.DoubleType()


def test_rules_that_are_not_understood_are_refused():
    with pytest.raises(ValueError, match="uniqueItems"):
        contracts.Contract({"type": "array", "items": {"type": "object"}, "uniqueItems": True})


def test_text_that_is_no_json_is_kept_apart(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "null"), (5, '{"_txId":7,"_politicianId":"P000001","txType":"sell","txDate":"2024-02-29","value":1,"size":null,"other":[]}')], "k bigint, text string")
    good, bad = contracts.parted(contracts.checked(rows, contracts.Contract(contracts.TRADE), "text"))
    assert [(r.k, r.record["_txId"], r.record["txDate"]) for r in good.collect()] == [(5, 7, dt.date(2024, 2, 29))]
    assert {r.k: r.errors for r in bad.collect()} == {1: ["no JSON"], 2: ["no JSON"], 3: ["no JSON"], 4: ["$: not object"]}


# Versions of tables.


def oldest(spark):
    return {
        "trades": spark.createDataFrame([(1, 100), (2, 0), (3, None)], "tx_id bigint, value bigint"),
        "politicians": spark.createDataFrame([("P1",)], "politician_id string"),
        "issuers": spark.createDataFrame([(1, "A:US"), (2, "B")], "issuer_id bigint, ticker string"),
    }


def state(tables):
    return {n: (t.columns, sorted(map(str, t.collect()))) for n, t in tables.items()}


@pytest.mark.parametrize("stop", range(versions.LATEST + 1))
def test_every_version_reaches_the_same_state(spark, stop):
    sectors = spark.createDataFrame([("A", "Energy")], "ticker string, sector string")
    at = versions.migrated(spark, oldest(spark), stop) if stop else oldest(spark)
    assert versions.version_of(at) == stop
    end = state(versions.migrated(spark, at, sectors=sectors))
    assert end == state(versions.migrated(spark, oldest(spark), sectors=sectors)) == state(versions.migrated(spark, versions.migrated(spark, at, sectors=sectors), sectors=sectors))
    assert end["meta"][1] == ["Row(key='schema_version', value='10')"] and "gics_sector='Energy'" in end["issuers"][1][0] and len(end["sector_benchmarks"][1]) == 11


def test_what_earlier_versions_left_empty_is_filled(spark):
    tables = {
        "trades": spark.createDataFrame([(1, 100, 4.0, None, None), (2, 100, 4.0, 7.0, 28.0), (3, 0, 4.0, None, None), (4, 9, None, None, None)], "tx_id bigint, value bigint, trade_date_price double, estimated_shares double, estimated_value double"),
        "donation_sync": spark.createDataFrame([("P", "C", 5, 2), ("P", "C", 9, 3)], "politician_id string, committee_id string, last_index bigint, total_synced bigint"),
        "meta": spark.createDataFrame([("schema_version", "6"), ("other", "x")], "key string, value string"),
    }
    out = versions.migrated(spark, tables | {"sector_benchmarks": spark.createDataFrame([("Energy", "OLD", "kept")], "sector string, etf_ticker string, etf_name string")})
    got = {r.tx_id: (r.estimated_shares, r.estimated_value, r.price_source) for r in out["trades"].collect()}
    assert got == {1: (25.0, 100.0, "yahoo"), 2: (7.0, 28.0, "yahoo"), 3: (None, None, "yahoo"), 4: (None, None, None)}
    assert [(r.cycle, r.last_index) for r in out["donation_sync"].collect()] == [(None, 9)]
    assert [(r.etf_ticker, r.etf_name) for r in out["sector_benchmarks"].where("sector = 'Energy'").collect()] == [("XLE", "kept")]
    assert {r.key: r.value for r in out["meta"].collect()} == {"schema_version": "10", "other": "x"}
    with pytest.raises(ValueError, match="can't go back"):
        versions.migrated(spark, out, 3)
