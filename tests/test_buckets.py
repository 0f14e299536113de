"""Merges that rewrite touched buckets only, changes published together, statistics that add up."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import merge, statistics
from quillstone.operators.buckets import Buckets, upsert_buckets
from quillstone.streaming import incremental


def folders(base, name):
    return {f"{d}/{b}" for d in os.listdir(f"{base}/{name}") for b in os.listdir(f"{base}/{name}/{d}") if b.startswith("_bucket=")}


def trades(spark, ids, value=1):
    return spark.createDataFrame([(i, f"P{i % 100:03d}", value * i, dt.date(2024, 1, 1 + i % 28)) for i in ids], "tx_id bigint, politician_id string, value bigint, tx_date date")


def test_a_hundredth_of_the_trades_rewrites_one_bucket(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}", 64)
    store.create(trades=(trades(spark, range(2000)), ["politician_id"]))
    before = folders(tmp_path, "trades")
    coming = trades(spark, [*range(7, 2000, 100), 2007], value=3)
    touched = store.merge(trades=(coming, merge.upsert_trades))
    assert len(touched["trades"]) == 1 and len(folders(tmp_path, "trades") - before) == 1 and before <= folders(tmp_path, "trades")
    got = {r.tx_id: r.value for r in store.read("trades").collect()}
    assert got == {i: 3 * i if i % 100 == 7 else i for i in [*range(2000), 2007]}
    assert store.sweep() == 1 and len(folders(tmp_path, "trades")) == len(before) and store.read("trades").count() == 2001
    assert store.merge(trades=(coming.where("false"), merge.upsert_trades)) == {"trades": []}


def test_tables_are_published_together(spark, tmp_path):
    """A change whose second table fails leaves the first one as it was; a change is taken once."""
    store = Buckets(spark, f"file://{tmp_path}", 8)
    gifts = lambda *ids: spark.createDataFrame([(i, 1.0) for i in ids], "sub_id string, amount double")
    cursors = lambda at: spark.createDataFrame([("P1", "C1", 2024, at, 2)], "politician_id string, committee_id string, cycle int, last_index bigint, total_synced bigint")
    store.create(donations=(gifts("a", "b"), ["sub_id"]), cursors=(cursors(2), ["politician_id"]))

    def fails(stored, moved):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.merge(0, donations=(gifts("c"), merge.insert_donations), cursors=(cursors(3), fails))
    seen = lambda: (sorted(r.sub_id for r in store.read("donations").collect()), [(r.last_index, r.total_synced) for r in store.read("cursors").collect()])
    assert seen() == (["a", "b"], [(2, 2)])
    for _ in range(2):
        store.merge(0, donations=(gifts("c", "b"), merge.insert_donations), cursors=(cursors(3), merge.save_cursors))
    assert seen() == (["a", "b", "c"], [(3, 4)])
    with pytest.raises(ValueError, match="moved rows"):
        store.merge(donations=(gifts("a"), lambda s, n: s.unionByName(gifts(*map(str, range(50))))))


def test_a_stream_changes_buckets_once(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/store", 16)
    store.create(trades=(trades(spark, []), ["tx_id"]))
    for part in (range(10), range(5, 15)):
        trades(spark, part, value=part[0] + 1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            upsert_buckets(incremental.read_new(spark, f"{tmp_path}/in", trades(spark, []).schema), store, f"{tmp_path}/state", lambda batch: {"trades": (batch, merge.upsert_trades)})
    assert {r.tx_id: r.value for r in store.read("trades").collect()} == {i: i if i < 5 else 6 * i for i in range(15)}


def test_states_add_up_to_a_recount(spark):
    rows = [(i, f"P{i % 7}" if i % 11 else None, i % 5, float(i) if i % 3 else None, dt.date(2024, 1, 1 + i % 28)) for i in range(300)]
    every = spark.createDataFrame(rows, "tx_id bigint, politician_id string, issuer_id bigint, value double, tx_date date")
    key, other = "issuer_id", "politician_id"
    parts = [every.where(F.col("tx_id") % 3 == k) for k in range(3)] + [every.where("false")]
    states, known = statistics.state(parts[0], key, other), statistics.pairs(parts[0], key, other)
    for p in parts[1:]:
        states, known = statistics.added(states, statistics.state(p, key, other), key), statistics.added_pairs(known, statistics.pairs(p, key, other))
    got = sorted(map(tuple, statistics.told(states, known, key).collect()))
    assert got == sorted(map(tuple, statistics.told(statistics.state(every, key, other), statistics.pairs(every, key, other), key).collect()))
    want = {k: [r for r in rows if r[2] == k] for k in range(5)}
    assert got == [(k, len(v), sum(r[3] or 0 for r in v), max(r[4] for r in v), len({r[1] for r in v} - {None}), len({r[1] for r in v} - {None})) for k, v in sorted(want.items())]
