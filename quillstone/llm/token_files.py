"""Documents' token ids as Simple-8b files in ascending doc_id order, written and read back by Spark tasks.

Rows are dealt out by ranges of doc_id and sorted; each task writes one file in the shared folder. Files hold some
FILE_BYTES of text and FILE_DOCS documents, so there are as many as the input takes, and a task holds the table of
one file's documents, whatever the input. A file's
name follows from its range, and it appears only when complete, so a lost task is simply run again. Reading
deals out the files; starts over all files are sums over the manifest, which has a row for each file.

A null text counts as empty and leaves the end id alone. A null doc_id sorts first and stays null. Rows that
repeat a doc_id follow one another in order of text. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, new_folder, short, staged, table
from quillstone.llm.files import opened, written
from quillstone.llm.simple8b import Reader, Writer
from quillstone.llm.vocab import WordBpe, default_path, loaded


#: Bytes of text and documents of a file, as ranges of doc_id come out even.
FILE_BYTES, FILE_DOCS = 16 << 20, 100_000


def files_for(docs: DataFrame, id_col: str, text_col: str) -> int:
    """The number of files for so much text and so many documents; ids alone and lengths are read."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column(text_col)).cast("bigint")), F.lit(0)).alias("b")).first()
    return max(1, -(-size.b // FILE_BYTES), -(-size.n // FILE_DOCS))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; the manifest: (part, path, n_docs, n_ids), a row for each file."""
    spark = docs.sparkSession
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = short(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc, part = loaded(WordBpe, vocabulary), TaskContext.get().partitionId()
        path, end = f"{folder}/part-{part:06d}.s8b", np.array([end_id], "<u4").tobytes()
        with written(path) as out:
            file = Writer(out)
            for batch in (b for bs in ([first], batches) for b in bs):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    file.add(doc, enc.bytes_of(text.as_py() or "") + end)
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(file.docs)], pa.int64()), pa.array([file.ids], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    rows = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))
    dealt = rows.repartitionByRange(files_for(docs, id_col, text_col), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint"), "token-manifest")


def read_token_files(manifest: DataFrame, run_ids: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ids are read block by block."""
    starts = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    file = Reader(source)
                    docs = file.docs
                    begin = np.append(docs[:, 2], file.ids)
                    at = 0
                    while at < len(docs):
                        to = max(at + 1, int(np.searchsorted(begin, begin[at] + run_ids, side="right")) - 1)
                        to = min(to, len(docs))
                        crcs = []
                        if begin[to] - begin[at] <= run_ids:
                            raw = file.read(int(begin[at]), int(begin[to] - begin[at])).astype("<u4").tobytes()
                            off = ((begin[at : to + 1] - begin[at]) * 4).tolist()
                            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                        else:  # one document beyond the run length: piece by piece
                            crc = 0
                            for k in range(int(begin[at]), int(begin[to]), run_ids):
                                crc = zlib.crc32(file.read(k, min(run_ids, int(begin[to]) - k)).astype("<u4").tobytes(), crc)
                            crcs = [crc]
                        part = docs[at:to]
                        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0], mask=part[:, 1] == 1), pa.array(part[:, 2] + base), pa.array(np.diff(begin[at : to + 1])), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = to

    # A task for each file, up to a million of them.
    n = max(1, min(manifest.count(), 1_000_000))
    return starts.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-files"), default_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest)
