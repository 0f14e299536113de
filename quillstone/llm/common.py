"""What the training-data operators share: the shared folder, staged tables and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function sees at once, and bytes that Spark sends it at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir as the session has it, or the checkpoint folder set on the context. 

    Where all are unset, a session in local mode, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (kept.get() if kept.isDefined() else None)
    if not found and sc.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="quillstone-")
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not kept.isDefined():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/quillstone/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame, name: str, alone: bool = False) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. With alone, the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    given = spark.conf.get(CLEANUP, "false")
    if alone:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, given)
    out = spark.read.schema(df.schema).parquet(folder)
    out.staged_in = folder
    return out


def unstaged(*tables: DataFrame) -> None:
    """Removes the files of tables as staged returned them, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_in)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Lowers the bytes of an Arrow batch to BATCH_BYTES for the session: whole texts beside each other take memory on both sides of a Python worker. All operators set this one value, so it doesn't matter which plan runs when."""
    name, factor = "spark.sql.execution.arrow.maxBytesPerBatch", {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    given = spark.conf.get(name).lower().removesuffix("b")
    size = int(given[:-1]) * factor[given[-1]] if given[-1:] in factor else int(given)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def short(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column(*path: str) -> Column:
    """A column, or a field within one, whatever characters its name holds."""
    return F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
