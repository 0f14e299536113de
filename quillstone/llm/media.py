"""Media columns: bytes stored as MPEG audio streams and read back with their durations and seek offsets.

`stored` turns texts into a binary column of streams; `described` parses any column of MPEG audio. Both are
narrow: one row in, one row out, without a shuffle.

A null text counts as empty; its payload is 64 zero bytes. Null or unreadable media have zero frames and a
null payload. Repeated rows are described each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, short, table
from quillstone.llm.mpeg import scan, unwrap, wrap

UNIT = 64


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media)."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 500):
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([wrap(padded(r)) for r in raw], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


_FACTS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames bigint, samples bigint, rate bigint, seconds_numerator bigint, seconds_denominator bigint, skipped_bytes bigint, failed_checksums bigint, table_frames bigint, seek_offsets array<bigint>"


def described(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns of keep, and what the streams hold: exact duration as a fraction, frame offsets, checksums, the payload's digests."""
    names = [x.strip().split(" ")[0] for x in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 8, pa.list_(pa.int64())]

    def facts(raw: bytes | None) -> tuple:
        raw = raw or b""
        s = scan(raw)
        try:
            payload = unwrap(raw, s)
        except (ValueError, KeyError):
            payload = None
        whole = () if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
        return (*(whole or (None, None, None)), len(raw), hashlib.sha256(raw).hexdigest(), len(s.offsets), s.samples, s.headers[0].rate if s.headers else None, s.duration.numerator, s.duration.denominator, s.skipped, s.failed, (s.vbr or {}).get("frames"), s.offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 500):
            cols = list(zip(*[facts(x.as_py()) for x in batch.column(len(keep))], strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [*keep, *names])

    head = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*keep, media_col).mapInArrow(run, f"{head}, {_FACTS}")


def op9_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = described(stored(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("table="), "table_frames"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("seconds="), "seconds_numerator", F.lit("/"), "seconds_denominator"), F.concat(F.lit("failed="), "failed_checksums"), F.concat(F.lit("seek="), F.md5(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")))))
    return facts.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "frames", "samples", "rate", "seconds_numerator", "seconds_denominator", "seek_offsets")
