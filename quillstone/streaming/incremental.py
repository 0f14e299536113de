"""Incremental loads and volume windows as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import captures
from quillstone.sources.shared import shared_folder


def _folder(spark: SparkSession) -> str:
    """Where a stream keeps its state and what it writes."""
    return shared_folder(spark, "stream")


def read_new(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files that land in a folder; which of them are done is the checkpoint's knowledge, so nothing is read twice."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str, keep: int = 2) -> None:
    """Merges each micro-batch into versions of a table: a batch that is run again writes the same version, so the merge is exactly once. Only the newest `keep` versions stay."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        stored = latest(spark, target, number)
        out = batch if stored is None else merge(stored, batch)
        out.write.mode("overwrite").parquet(f"{target}/v={number:09d}")
        fs, path = _files(spark, target)
        for old in _versions(spark, target)[:-keep]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, old), True)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_stream(rows: DataFrame, keys: list[str], target: str, checkpoint: str) -> None:
    """Appends the rows of each micro-batch whose keys are new: a batch adds one folder of its own and reads only the keys of those before, so no batch rewrites the table."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        first = batch.dropDuplicates(keys)
        before = [v for v in _versions(spark, target) if int(v[2:]) < number]
        if before:
            first = first.join(spark.read.schema(batch.schema).parquet(*[f"{target}/{v}" for v in before]).select(*keys), keys, "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/v={number:09d}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, target: str) -> list[str]:
    fs, path = _files(spark, target)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table (older than a batch number)."""
    names = [n for n in _versions(spark, target) if before is None or int(n[2:]) < before]
    return spark.read.parquet(f"{target}/{names[-1]}") if names else None


def volume_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = "2 hours") -> DataFrame:
    """Counts and sums by window and type. With a watermark rows later than that are left out, and in append mode a window comes out once it has passed; late=None takes all rows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    total = F.sum(F.col("value").cast("decimal(18, 4)")).cast("double")
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(w, "event_type").agg(F.count("*").alias("n"), total.alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def changes_stream(rows: DataFrame, target: str, checkpoint: str, mode: str = "update") -> None:
    """Keeps what an aggregation in update mode changes, or appended rows, a folder for each micro-batch; nothing is rewritten."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/v={number:09d}")

    rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last state of each key that changes_stream wrote."""
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in (*keys, "v")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "v").alias("last"))
    return last.select(*keys, "last.*")


def append_within(rows: DataFrame, keys: list[str], time: str, late: str, target: str, checkpoint: str):
    """Appends the first row of each key; the keys of `late` and no more are kept as state, so that it stays bounded however long the stream runs. Repeats that come later than that, and rows behind the watermark, are the source's promise not to send. The finished query is returned for its progress."""
    first = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    query = first.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """Extra: each user's sessions, which end after a gap. With a watermark a session comes out once it has passed; without one (late=None) events are a whole table."""
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_volume_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the events, closed or still open when they end."""
    base = _folder(spark)
    changes_stream(volume_windows(_events(spark, sf_dir), late=None), f"{base}/out", f"{base}/state")
    return current(spark, f"{base}/out", ["start", "end", "event_type"])


def stream_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as donations, in batches: the first of each sub_id stays."""
    base = _folder(spark)
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("sub_id"), F.col("user_id"), F.col("value").alias("amount"))
    append_stream(rows, ["sub_id"], f"{base}/donations", f"{base}/state")
    return spark.read.parquet(f"{base}/donations").drop("v")


def stream_dedup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as donations that arrive twice within two hours: each sub_id once, with no more state than that time's keys."""
    base = _folder(spark)
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("sub_id"), "user_id", F.col("value").alias("amount"), "ts")
    append_within(rows.unionByName(rows.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))), ["sub_id"], "ts", "2 hours", f"{base}/donations", f"{base}/state")
    return spark.read.parquet(f"{base}/donations").select("sub_id", "user_id", "amount")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(events, "6 hours", late=None)


def pull_captures(spark: SparkSession, captured: str, target: str, checkpoint: str) -> None:
    """Takes the responses captured since the last run, and their records, into folders of one micro-batch each: a batch that is run again replaces its own. After a failure a run finishes that batch, and the next one takes what came since."""
    changes_stream(captures.results(captures.stream_captures(spark, captured), "sub_id string, user_id bigint, amount double"), target, checkpoint, "append")


def captured_donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull in two runs: the second resumes behind the last cursor of the first."""
    base = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.to_date(F.col("ts").cast("timestamp")).alias("date"), F.col("event_id").cast("bigint").alias("index"), F.col("event_id").cast("string").alias("sub_id"), "user_id", F.col("value").alias("amount"))
    for part in (rows.where("date < date '2024-01-16'"), rows.where("date >= date '2024-01-16'")):
        captures.write_captures(part, f"{base}/captured")
        pull_captures(spark, f"{base}/captured", f"{base}/donations", f"{base}/state")
    return spark.read.parquet(f"{base}/donations").select("last_date", "sub_id", "user_id", "amount")


def captured_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses from a day on, as a table: other days' responses aren't opened where filters are pushed down."""
    base = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.to_date(F.col("ts").cast("timestamp")).alias("date"), F.col("event_id").cast("bigint").alias("index"), "user_id", F.col("value").alias("amount"))
    captures.write_captures(rows, f"{base}/captured")
    found = captures.results(captures.read_captures(spark, f"{base}/captured").where("last_date >= '2024-01-20'"), "index bigint, user_id bigint, amount double")
    return found.select("last_date", F.col("index").alias("event_id"), "user_id", "amount")


def queries() -> dict:
    return {"stream_volume_window": stream_volume_window, "stream_incremental_ingest": stream_incremental_ingest, "stream_dedup_bounded": stream_dedup_bounded, "user_sessions": user_sessions, "captured_donations": captured_donations, "captured_since": captured_since}


def oracle_sql() -> dict[str, str]:
    start = "time_bucket(interval '1 hour', cast(ts as timestamp))"
    return {
        "stream_volume_window": f"select {start} as start, {start} + interval '1 hour' as \"end\", event_type, count(*) as n, cast(sum(cast(value as decimal(18, 4))) as double) as total from events group by all",
        "stream_incremental_ingest": "select cast(event_id as string) as sub_id, user_id, value as amount from events",
        "stream_dedup_bounded": "select cast(event_id as string) as sub_id, user_id, value as amount from events",
        "user_sessions": """with e as (select user_id, cast(ts as timestamp) as ts from events), g as (select *, coalesce(ts - lag(ts) over w >= interval '6 hours', true) as fresh from e window w as (partition by user_id order by ts)),
            s as (select *, sum(case when fresh then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from g)
            select min(ts) as start, max(ts) + interval '6 hours' as "end", user_id, count(*) as n from s group by user_id, k""",
        "captured_donations": "select cast(cast(ts as date) as string) as last_date, cast(event_id as string) as sub_id, user_id, value as amount from events",
        "captured_since": "select cast(cast(ts as date) as string) as last_date, cast(event_id as bigint) as event_id, user_id, value as amount from events where cast(ts as date) >= date '2024-01-20'",
    }
