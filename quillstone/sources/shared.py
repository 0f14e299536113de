"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names. Where it names none, a session in local mode gets a temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="quillstone-")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for plans that read it several times. The shuffle files of the write go as soon as it ends, the table when the application does."""
    spark = df.sparkSession
    folder, given = shared_folder(spark, name), spark.conf.get(_CLEANUP, "false")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, given)
    return spark.read.schema(df.schema).parquet(folder)
