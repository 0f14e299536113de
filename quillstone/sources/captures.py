"""Captured responses of paged interfaces as a data source, in batches and as a stream.

A capture is a folder `cursor=<date>_<index>` with one response: the cursor is where its last record stands, as
keyset paging hands it out, so captures sort in the order in which they were pulled. The source yields
(last_date, last_index, body), a partition for each capture; the JVM parses the bodies.

* Batch: comparisons of last_date and last_index are pushed down to the folders' names, so other captures aren't
  opened; what can't be told by a name is left to Spark.
* Stream: the offset is the last cursor read. A stream that is stopped resumes behind it, and captures that
  arrive later with an older cursor belong to another pull: they are an error, for an offset can't go back.

An empty folder has no rows, a capture without a response is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "last_date string, last_index bigint, body string"
_CURSOR = re.compile(r"cursor=(\d{4}-\d{2}-\d{2})_(\d+)$")
_HOLDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class Capture(InputPartition):
    def __init__(self, last_date: str, last_index: int, path: str):
        self.last_date, self.last_index, self.path = last_date, last_index, path

    @property
    def cursor(self) -> tuple[str, int]:
        return self.last_date, self.last_index


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def captures(uri: str) -> list[Capture]:
    """The captures of a folder by cursor: names only, no file is opened."""
    from pyarrow import fs

    system, path = _system(uri)
    found = [_CURSOR.search(f.path.rstrip("/")) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory]
    return sorted((Capture(m[1], int(m[2]), m.string.rstrip("/")) for m in found if m), key=lambda c: c.cursor)


def _read(uri: str, capture: Capture) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, _ = _system(uri)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(capture.path)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    if not files:
        raise FileNotFoundError(f"no response in {capture.path}")
    body = b"".join(system.open_input_file(f).read() for f in files).decode()
    yield pa.RecordBatch.from_arrays([pa.array([capture.last_date]), pa.array([capture.last_index], pa.int64()), pa.array([body])], ["last_date", "last_index", "body"])


class CaptureReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.kept = uri, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in ("last_date", "last_index"):
                self.kept.append((f.attribute[0], _HOLDS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Capture]:
        return [c for c in captures(self.uri) if all(holds(getattr(c, name), value) for name, holds, value in self.kept)]

    def read(self, partition: Capture) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition) if partition is not None else iter(())


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"last_date": "", "last_index": 0, "captures": 0}

    def latestOffset(self) -> dict:
        found = captures(self.uri)
        return {"last_date": found[-1].last_date, "last_index": found[-1].last_index, "captures": len(found)} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Capture]:
        before, upto = ((o["last_date"], o["last_index"]) for o in (start, end))
        found = [c for c in captures(self.uri) if c.cursor <= upto]
        if len(found) != end["captures"]:
            raise ValueError(f"{len(found)} captures up to {upto}, {end['captures']} when that was offered: a pull only moves on")
        return [c for c in found if c.cursor > before]

    def read(self, partition: Capture) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)


class PlainCaptureReader(DataSourceReader):
    """For sessions that don't push filters down to Python sources: Spark refuses readers that take them."""

    def __init__(self, uri: str):
        self.uri = uri

    partitions, read, kept = CaptureReader.partitions, CaptureReader.read, ()


class CaptureSource(DataSource):
    """spark.read.format("captures").load(folder), once registered."""

    reads = CaptureReader

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options["path"])

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options["path"])


class PlainCaptureSource(CaptureSource):
    reads = PlainCaptureReader


def _registered(spark: SparkSession) -> str:
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(CaptureSource if pushed else PlainCaptureSource)
    return "captures"


def read_captures(spark: SparkSession, uri: str) -> DataFrame:
    """Responses of a folder. Filters on the cursor reach the folder's names where the session pushes filters down to Python sources (spark.sql.python.filterPushdown.enabled); elsewhere Spark filters what was read."""
    return spark.read.format(_registered(spark)).load(uri)


def stream_captures(spark: SparkSession, uri: str) -> DataFrame:
    return spark.readStream.format(_registered(spark)).load(uri)


#: Range of indexes that a response may span, and so its records at most where indexes are unique.
PER_RESPONSE = 5000


def write_captures(records: DataFrame, uri: str, date: str = "date", index: str = "index") -> None:
    """Records as captures: those of a date, PER_RESPONSE of its indexes at a time. For pulls that Spark makes itself."""
    body = F.to_json(F.struct(F.collect_list(F.struct(*records.columns)).alias("results"), F.struct(F.max(index).alias("last_index"), F.first(date).cast("string").alias("last_date")).alias("pagination")))
    pages = records.groupBy(F.col(date).alias("_date"), F.floor(F.col(index) / PER_RESPONSE).alias("_range")).agg(body.alias("value"), F.max(index).alias("_last"))
    pages.select("value", F.concat(F.col("_date").cast("string"), F.lit("_"), F.col("_last").cast("string")).alias("cursor")).write.mode("append").partitionBy("cursor").text(uri)


def results(responses: DataFrame, schema: str) -> DataFrame:
    """The records of captured responses. schema: of one record."""
    return responses.select("last_date", "last_index", F.explode(F.from_json("body", f"results array<struct<{schema}>>")["results"]).alias("r")).select("last_date", "last_index", "r.*")
