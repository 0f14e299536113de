"""Tables in buckets of a key, of which a merge rewrites only those that it touches.

A bucket is a folder of Parquet files; a change writes new folders for the buckets of its rows and leaves all
others as they are. One pointer file names the folder of every bucket of every table, so tables that change
together, as donations and the cursor of their pull, are published together, by one rename. A change that fails
before that leaves nothing visible. A numbered change that is already published is left out, which makes
micro-batches exactly once. One writer at a time; readers keep what the pointer named when they began.

Buckets follow from a hash of columns that never change for a row: the key, or part of it whose rows change
together, such as a politician's trades. An empty bucket has no folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]
#: The column of a bucket's number; tables must not have it.
BUCKET = "_bucket"


class Buckets:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        file = self._path(f"{self.folder}/current.json")
        if not self._fs.exists(file):
            return {"change": -1, "tables": {}}
        return json.loads(self.spark.read.text(file.toString(), wholetext=True).first()[0])

    def _publish(self, pointer: dict) -> None:
        """Writes the pointer beside the old one and puts it in its place by one rename."""
        jvm = self.spark._jvm
        made = self._path(f"{self.folder}/pointer-{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(made, self._path(f"{self.folder}/current.json"), options)

    def _of(self, by: list[str]) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame, by: list[str], name: str) -> dict[str, str]:
        """The folder of each bucket that rows fill."""
        to = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._of(by)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(to)
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(to))]
        return {n.partition("=")[2]: f"{to}/{n}" for n in made if n.startswith(f"{BUCKET}=")}

    def create(self, **tables: tuple[DataFrame, list[str]]) -> None:
        """New tables, each with the columns that its buckets follow from."""
        pointer = self._pointer()
        for name, (rows, by) in tables.items():
            pointer["tables"][name] = {"by": by, "schema": rows.schema.json(), "folders": self._written(rows, by, name)}
        self._publish(pointer)

    def _read(self, table: dict, some: list[str] | None = None) -> DataFrame:
        folders = [f for b, f in table["folders"].items() if some is None or b in some]
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        return self._read(self._pointer()["tables"][name])

    def merge(self, change: int | None = None, **changes: tuple[DataFrame, Merge]) -> dict[str, list[int]]:
        """Merges rows into tables and publishes all of them at once; the buckets rewritten of each. Incoming rows are read twice: for their buckets, and to be merged."""
        pointer = self._pointer()
        if change is not None and change <= pointer["change"]:
            return {}
        touched = {}
        for name, (incoming, rule) in changes.items():
            table = pointer["tables"][name]
            # No more rows than there are buckets.
            some = sorted(str(r[0]) for r in incoming.select(self._of(table["by"])).distinct().collect())
            if some:
                made = self._written(rule(self._read(table, some), incoming), table["by"], name)
                if strange := sorted(set(made) - set(some)):
                    raise ValueError(f"a merge of {name} moved rows to buckets {strange}")
                table["folders"] = {b: f for b, f in table["folders"].items() if b not in some} | made
            touched[name] = sorted(map(int, some))
        self._publish(pointer | {"change": pointer["change"] if change is None else change})
        return touched

    def sweep(self) -> int:
        """Deletes folders that the pointer doesn't name, once no reader holds an older one; how many went."""
        gone = 0
        for name, table in self._pointer()["tables"].items():
            kept = set(table["folders"].values())
            for made in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                for part in self._fs.listStatus(made.getPath()):
                    path = part.getPath()
                    if path.getName().startswith(f"{BUCKET}=") and f"{self.folder}/{name}/{made.getPath().getName()}/{path.getName()}" not in kept:
                        gone += bool(self._fs.delete(path, True))
        return gone


def upsert_buckets(rows: DataFrame, store: Buckets, checkpoint: str, of_batch: Callable[[DataFrame], dict[str, tuple[DataFrame, Merge]]]) -> None:
    """A stream's micro-batches as changes of a store, each exactly once: the batch's number is published with what it changes."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        store.merge(number, **of_batch(kept))
        kept.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
