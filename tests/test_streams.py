"""Captured responses as a source, resumed pulls and bounded state."""

import datetime as dt

import pytest

from quillstone.sources import captures
from quillstone.streaming import incremental

RECORD = "sub_id string, user_id bigint, amount double"


def records(spark, days, each=3):
    rows = [(dt.date(2024, 1, d), 100 * d + i, f"s{100 * d + i}", i, float(d)) for d in days for i in range(each)]
    return spark.createDataFrame(rows, "date date, index bigint, " + RECORD)


def pulled(spark, base):
    return sorted(r.sub_id for r in spark.read.parquet(f"{base}/out").collect())


def test_a_pull_resumes_behind_its_cursor(spark, tmp_path):
    """After a stop, and after a batch that fails halfway, no record is missing or there twice."""
    base = str(tmp_path)
    captures.write_captures(records(spark, [1, 2, 3]), f"{base}/in")
    incremental.pull_captures(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    incremental.pull_captures(spark, f"{base}/in", f"{base}/out", f"{base}/state")  # nothing new
    assert len(pulled(spark, base)) == 9
    captures.write_captures(records(spark, [4, 5]), f"{base}/in")

    def fails(batch, number):
        batch.limit(2).write.mode("overwrite").parquet(f"{base}/out/v={number:09d}")
        raise RuntimeError("lost")

    rows = captures.results(captures.stream_captures(spark, f"{base}/in"), RECORD)
    with pytest.raises(Exception, match="lost"):
        rows.writeStream.foreachBatch(fails).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    captures.write_captures(records(spark, [6]), f"{base}/in")
    for _ in range(2):  # the batch that failed, then what came since
        incremental.pull_captures(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    assert pulled(spark, base) == sorted(f"s{100 * d + i}" for d in range(1, 7) for i in range(3))


def test_a_capture_out_of_order_is_an_error(spark, tmp_path):
    base = str(tmp_path)
    rows = records(spark, [2, 4])
    captures.write_captures(rows, f"{base}/in")
    reader = captures.CaptureStreamReader(f"{base}/in")
    end = reader.latestOffset()
    assert [c.cursor for c in reader.partitions(reader.initialOffset(), end)] == [("2024-01-02", 202), ("2024-01-04", 402)]
    captures.write_captures(records(spark, [3]), f"{base}/in")
    with pytest.raises(ValueError, match="only moves on"):
        reader.partitions(reader.initialOffset(), end)


def test_filters_reach_the_names_of_captures(spark, tmp_path):
    base = str(tmp_path)
    captures.write_captures(records(spark, range(1, 10)), f"{base}/in")
    assert captures.read_captures(spark, f"{base}/in").where("last_date >= '2024-01-08'").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = captures.read_captures(spark, f"{base}/in").where("last_date >= '2024-01-08' and last_index < 900 and body like '%s80%'")
        assert [r.last_index for r in some.collect()] == [802]
        assert some.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_folder_without_captures(spark, tmp_path):
    (tmp_path / "in" / "other").mkdir(parents=True)
    assert captures.read_captures(spark, f"{tmp_path}/in").count() == 0 and captures.captures(f"{tmp_path}/none") == []
    (tmp_path / "in" / "cursor=2024-01-01_5").mkdir()
    with pytest.raises(Exception, match="no response"):
        captures.read_captures(spark, f"{tmp_path}/in").count()


def test_state_of_repeats_stays_bounded(spark, tmp_path):
    """Ten batches of an hour each: the state holds the keys of some three hours, not of ten; repeats within that time go."""
    base, begin, sizes = str(tmp_path), dt.datetime(2024, 1, 1), []
    schema = "sub_id string, ts timestamp"
    for hour in range(10):
        rows = [(f"s{hour}-{i}", begin + dt.timedelta(hours=hour, seconds=36 * i)) for i in range(100)]
        again = [(f"s{hour - 1}-{i}", begin + dt.timedelta(hours=hour, seconds=36 * i)) for i in range(100)] if hour else []
        spark.createDataFrame(rows + again, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = incremental.append_within(incremental.read_new(spark, f"{base}/in", schema), ["sub_id"], "ts", "2 hours", f"{base}/out", f"{base}/state")
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.sub_id for r in spark.read.parquet(f"{base}/out").collect()) == sorted(f"s{h}-{i}" for h in range(10) for i in range(100))
    assert max(sizes) <= 400 and sizes[-1] <= 400


def test_sessions_of_users(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(0)), (1, at(20)), (1, at(60)), (2, at(5)), (None, at(5))], "user_id bigint, ts timestamp")
    got = sorted((r.user_id or 0, r.start, r.end, r.n) for r in incremental.sessions(rows, late=None).collect())
    assert got == [(0, at(5), at(35), 1), (1, at(0), at(50), 2), (1, at(60), at(90), 1), (2, at(5), at(35), 1)]
