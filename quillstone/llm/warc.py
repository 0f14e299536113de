"""WARC records in ZIP packages, written and read back by Spark tasks.

A package is a ZIP whose members are stored: `archive/data.warc.gz`, a gzip member for each record, and
`indexes/index.jsonl`, a line for each record with its page, address, offset and length. The reader finds
both in the central directory and fetches records by range, several neighbours at a time; nothing is
extracted.

Of pages with equal payloads the largest page_id is the response and the rest are revisits that refer to
it. A null html counts as empty. Rows that repeat the largest page_id are all responses. Rows with a null
page_id are revisits where an equal payload has a page_id, else responses. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, new_folder, short, staged, table
from quillstone.llm.files import opened, written
from quillstone.llm.zipread import directory, place

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payloads from this many bytes on are deduplicated; bytes fetched at once when records are neighbours.
LEAST_BYTES, FETCH_BYTES = 0, 8 << 20
#: Payload bytes after which a task begins another package.
PACKAGE_BYTES = 1 << 28
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: {digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's page, type, target and payload; the digest of a payload that is there is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": declared, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload}


def write_package(out, rows: Iterator[tuple[int | None, str | None, bytes, int | None, bool]], level: int = 3) -> int:
    """Writes a package to a stream; the number of records."""
    index, at = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=True) as data:
            for page_id, url, payload, refers_to, revisit in rows:
                packer = zlib.compressobj(level, wbits=31)
                raw = packer.compress(record(page_id, url, payload, refers_to, revisit)) + packer.flush()
                data.write(raw)
                index.append(json.dumps({"page": page_id, "url": url, "offset": at, "length": len(raw)}))
                at += len(raw)
        z.writestr(INDEX, "\n".join(index) + "\n" * bool(index))
    return len(index)


def read_package(source, fetch_bytes: int = FETCH_BYTES) -> Iterator[dict]:
    """All records of a package, by its index."""
    members = directory(source)
    index_at, index_size = place(source, members[INDEX])
    data_at, _ = place(source, members[DATA])
    entries = [json.loads(x) for x in source.read_at(index_size, index_at).decode().splitlines()]
    k = 0
    while k < len(entries):
        first, to = entries[k]["offset"], k + 1
        while to < len(entries) and entries[to]["offset"] + entries[to]["length"] - first <= fetch_bytes:
            to += 1
        last = entries[to - 1]
        raw = source.read_at(last["offset"] + last["length"] - first, data_at + first)
        for e in entries[k:to]:
            yield parse(zlib.decompress(raw[e["offset"] - first : e["offset"] - first + e["length"]], wbits=31))
        k = to


def write_packages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages, one or more for each task and none much beyond package_bytes of payload; the manifest: (path, n_records)."""
    bounded(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    groups = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("c")).where("c > 1").select("key", "best")
    # Written before it is joined, so that a payload of very many pages can be split among tasks.
    groups = staged(groups, "warc-groups")
    decided = rows.join(groups, "key", "left").select("page_id", "url", "html", "best", F.expr("best is not null and not (page_id <=> best)").alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = short(batches, 500)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()

        def each() -> Iterator[tuple]:
            for batch in (b for bs in ([first], batches) for b in bs):
                for page, url, html, best, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield page, url, html.encode(), best if revisit else None, revisit

        rows = each()
        upcoming = next(rows, None)

        def package() -> Iterator[tuple]:
            nonlocal upcoming
            size = 0
            while upcoming is not None and (size == 0 or size + len(upcoming[2]) <= package_bytes):
                size += len(upcoming[2]) + 1
                yield upcoming
                upcoming = next(rows, None)

        k = 0
        while upcoming is not None:
            path = f"{folder}/part-{part:06d}-{k:04d}.wacz"
            with written(path) as out:
                n = write_package(out, package())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])
            k += 1

    return staged(decided.mapInArrow(run, "path string, n_records bigint"), "warc-manifest")


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; one task for each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 500):
            for path in batch.column(0).to_pylist():
                system, at = opened(path)
                with system.open_input_file(at) as source:
                    rows = []
                    for r in read_package(source):
                        rows.append({k: r[k] for k in _RECORDS.names})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages"), new_folder(spark, "warc")))


#: Digests in base32, five bits at a time.
SQL = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS best FROM p),
    b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM d)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, 5 * g + k, 1) AS INTEGER) * (32 >> k))) AS INTEGER), 1)), '') AS payload_digest,
        CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
    FROM b"""
