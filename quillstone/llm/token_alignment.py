"""Tokens of two tokenizers aligned by byte offsets, as joins and windows over exploded tokens.

A text is cut where neither tokenizer lets a token reach across: before an ASCII mark or digit that follows a
Latin letter, and before a blank or newline that follows a visible character below U+0250. The vocabularies are
asked whether that holds (no piece of B contains such a place); if not, a text is one segment. So each distinct
segment is encoded and aligned once, whatever its number of occurrences:

* tokens are exploded and their lengths summed in a window, which gives each its end;
* the ends of both sides meet by equality of (segment, end), as one grouping of the union, which is a full outer
  join of two sides that hold each end once;
* an end of both is a cut, and running counts of cuts number the groups;
* links need no join of a group's tokens: the bytes between two neighbouring ends lie in exactly one token of
  either side, and two tokens overlap in exactly one such piece. A row of the join is a link, once each side's
  next token is filled in by a window.

The most frequent segments, at most `most_frequent` of them, are broadcast and documents become lists of their
numbers; the rest, a few hundredths of all occurrences, meet the documents by joins. Documents that hold a pair of ids are counted over all documents, and
the counts come back as sums for each segment.

A null or empty text, or one whose joined token bytes of either side differ from blank + text, has no tokens: zeros
and an empty digest. Each row is a document: rows repeated whole, or that share a doc_id, count each. A null doc_id
stays null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, short, staged, table
from quillstone.llm.vocab import ByteBpe, default_path, loaded

#: Segments whose alignment every worker holds; their share of all occurrences grows slowly, the rest is joined.
MOST_FREQUENT = 1 << 19
#: Distinct segments, and pairs of ids, that a task gathers before it hands them on.
FLUSH_SEGMENTS, FLUSH_PAIRS = 400_000, 1 << 21
#: Bits of an id of B within a pair; bits of an id beside the bytes of its token. Vocabularies that don't fit are refused.
B_BITS, ID_BITS = 24, 20

_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_MARK = r"!-@\[-`{-~"
_SEEN = "!-~¡-ɏ"
#: A segment: blanks, then marks and letters up to the next place to cut; the last form takes any other text.
_SEGMENT = re.compile(rf"[ \n]*+[{_MARK}]*+[{_LATIN}]++(?=[{_MARK} \n]|\Z)|[ \n]*+[{_MARK}]++(?=[ \n]|\Z)|(?s:.(?:(?!(?<=[{_LATIN}])(?=[{_MARK}])|(?<=[{_SEEN}])(?=[ \n])).)*+)")
_WHOLE = re.compile(r"(?s:.+)")
_CROSSED = re.compile(rf"[{_LATIN}][{_MARK}]|[{_SEEN}][ \n]")


class Aligned:
    """Both vocabularies: ids of segments, and the bytes that each id stands for."""

    def __init__(self, paths: tuple[str, str]):
        import sentencepiece

        self.a = ByteBpe(paths[0])
        self.a.tok.encode_special_tokens = True  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        from quillstone.llm.vocab import _byte_alphabet

        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.tok.get_vocab_size()
        for token, i in self.a.tok.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), n) > 1 << ID_BITS or max(map(len, (*self.a_bytes, *self.b_bytes))) >= 1 << (31 - ID_BITS):
            raise ValueError(f"ids beyond {ID_BITS} bits, or tokens of {1 << (31 - ID_BITS)} bytes")
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether B's pieces stay within segments. A's word pattern ends a token at each such place.
        self.cuts = not any(_CROSSED.search(p.replace("▁", " ")) for p in own)
        self.segments = (_SEGMENT if self.cuts else _WHOLE).findall

    def ids_a(self, segments: list[str]) -> list[list[int]]:
        plain = self.a.ranks is not None
        if plain and all(s.isascii() for s in segments):
            return list(map(self.a.ranks.encode_ordinary, segments))
        return [self.a.ranks.encode_ordinary(s) if plain and max(s) < "ɐ" else self.a.tok.encode(s, add_special_tokens=False).ids for s in segments]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """B adds a blank in front, but none to an empty text; a segment without a blank, or of one alone, stands after a visible character, so it is encoded after a letter whose piece is taken off."""
        after = [s[0] != " " or s == " " for s in segments]
        ids = self.b.encode(["a" + s if x else s[1:] for s, x in zip(segments, after, strict=True)], num_threads=1)
        return [y[1:] if x else y for y, x in zip(ids, after, strict=True)]


def _aligned(paths: tuple[str, str]) -> Aligned:
    return loaded(Aligned, paths)


_COUNTED = pa.schema([("seg", pa.string()), ("n", pa.int64())])


def _counted_segments(paths: tuple[str, str]):
    """(seg, n): segments of a task's texts with their occurrences, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _aligned(paths).segments, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=_COUNTED)

        for batch in short(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(cut(" " + text))
                    if len(seen) > FLUSH_SEGMENTS:
                        yield out()
                        seen.clear()
        yield out()

    return run


_ENCODED = pa.schema([("sid", pa.int64()), ("seg", pa.string()), ("n", pa.int64()), ("ok", pa.bool_()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def _encoded(paths: tuple[str, str]):
    """Numbers the segments and adds both sides' tokens: id, and number of bytes above ID_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, at = _aligned(paths), TaskContext.get().partitionId() << 33
        for batch in short(batches, 4000):
            segs = batch.column(0).to_pylist()
            if not segs:
                continue
            sides, ok = [], [True] * len(segs)
            for ids, raw in ((enc.ids_a(segs), enc.a_bytes), (enc.ids_b(segs), enc.b_bytes)):
                parts = [[raw[i] for i in x] for x in ids]
                ok = [o and b"".join(p) == s.encode() for o, p, s in zip(ok, parts, segs, strict=True)]
                sides.append([[i | len(b) << ID_BITS for i, b in zip(x, p, strict=True)] for x, p in zip(ids, parts, strict=True)])
            cols = [pa.array(np.arange(at, at + len(segs)), pa.int64()), batch.column(0), batch.column(1), pa.array(ok, pa.bool_()), *(pa.array(x, pa.list_(pa.int32())) for x in sides)]
            yield pa.RecordBatch.from_arrays(cols, schema=_ENCODED)
            at += len(segs)

    return run


def aligned_segments(encoded: DataFrame) -> DataFrame:
    """(sid, seg, n, n_a, n_b, n_groups, n_links, groups, links) of each segment of (sid, seg, n, ok, a, b); groups is null where not ok. links: pairs of ids as one number each."""
    # Segments are dealt out before their tokens are exploded. seg and n stand on one row of each only, so that windows don't carry them along.
    token = lambda s, k: F.transform(s, lambda t: F.struct(F.lit(k).alias("side"), t.alias("t")))
    tokens = encoded.where("ok").repartition("sid").select("sid", "seg", "n", F.posexplode(F.concat(token("a", 0), token("b", 1))).alias("pos", "x"))
    one = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    tokens = tokens.select("sid", "x.side", "pos", F.col("x.t").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id"), F.shiftright("x.t", ID_BITS).alias("len"), one("seg"), one("n"))
    ends = tokens.withColumn("end", F.sum("len").over(Window.partitionBy("sid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    met = ends.groupBy("sid", "end").agg(*[F.max(F.when(F.col("side") == k, F.col("id"))).alias(c) for k, c in enumerate("ab")], F.max("seg").alias("seg"), F.max("n").alias("n"))
    # From the last end backwards, so that frames only run from the first row to the current one.
    back = Window.partitionBy("sid").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    links = met.select("sid", "end", "a", "b", "seg", "n", F.sum(cut.cast("int")).over(back).alias("g"), *[F.last(c, True).over(back).alias(f"link_{c}") for c in "ab"])
    pair = F.shiftleft(F.col("link_a").cast("bigint"), B_BITS).bitwiseOR(F.col("link_b").cast("bigint"))
    ids = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", F.col(c).alias("id")))))
    groups = links.groupBy("sid", "g").agg(ids("a").alias("a"), ids("b").alias("b"), F.collect_list(pair).alias("links"), F.max("seg").alias("seg"), F.max("n").alias("n"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",")
    told = groups.select("sid", "seg", "n", F.size("a").cast("bigint").alias("n_a"), F.size("b").cast("bigint").alias("n_b"), "links", F.struct((-F.col("g")).alias("k"), F.concat(text("a"), F.lit("|"), text("b")).alias("s")).alias("group"))
    sums = told.groupBy("sid").agg(F.max("seg").alias("seg"), F.max("n").alias("n"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sort_array(F.collect_list("group")).alias("told"), F.flatten(F.collect_list("links")).alias("links"))
    good = sums.select("sid", "seg", "n", "n_a", "n_b", "n_groups", F.size("links").cast("bigint").alias("n_links"), F.array_join(F.transform("told", lambda x: x["s"]), ";").alias("groups"), "links")
    none = encoded.where("not ok").select("sid", "seg", "n", *[F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.lit(None).cast("string").alias("groups"), F.array().cast("array<bigint>").alias("links"))
    return good.unionByName(none)


def _least_frequent(segments: DataFrame, most: int) -> int:
    """The occurrences from which on segments count as frequent, so that at most `most` do; from some 500 counts of classes."""
    of_class = F.floor(8 * F.log2("n")).cast("int")
    total = 0
    for k, c in sorted(segments.groupBy(of_class.alias("k")).count().collect(), reverse=True):
        if total + c > most:
            return int(np.ceil(2 ** ((k + 1) / 8)))
        total += c
    return 1


def packed(ids: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, in which the higher ones are mostly zeros."""
    return np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_CODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("code", pa.binary()), ("rare", pa.list_(pa.string()))])


def _coded(paths: tuple[str, str], frequent):
    """(row, doc_id, code, rare): each text as numbers of its segments, compressed; those beyond the frequent ones number its rare segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        cut, known = _aligned(paths).segments, frequent.value
        number, most, pack, at = known.get, len(known), zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 33
        for batch in short(batches):
            codes, rares = [], []
            for text in batch.column(1).to_pylist():
                segs = cut(" " + text) if text else []
                ids = np.fromiter(map(number, segs, repeat(-1)), np.int32, len(segs))
                missed = np.flatnonzero(ids < 0).tolist()
                rare = sorted({segs[k] for k in missed})
                of_rare = {s: most + k for k, s in enumerate(rare)}
                ids[missed] = [of_rare[segs[k]] for k in missed]
                codes.append(pack(packed(ids)))
                rares.append(rare)
            rows = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(codes, pa.binary()), pa.array(rares, pa.list_(pa.string()))], schema=_CODED)
            at += batch.num_rows

    return run


_SUMS = ("n_a", "n_b", "n_groups", "n_links")
_DOC = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("groups_sha256", pa.string()), ("rare", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int32()))])
_BOTH = pa.schema([*_DOC, ("pair", pa.int64()), ("n_docs", pa.int64())])
_BOTH_SQL = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, rare array<bigint>, rare_n array<int>, pair bigint, n_docs bigint"


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), kind))


class Held:
    """How many documents hold each pair: a count for each pair of the frequent segments, lists for others."""

    def __init__(self, known: np.ndarray):
        self.known, self.counts, self.seen, self.others, self.size = known, np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), [], 0

    def add(self, numbers: np.ndarray, others: np.ndarray) -> None:
        """A document's pairs: numbers of known ones, and pairs that may or may not be known."""
        if len(others):
            at = np.searchsorted(self.known, others)
            at[at == len(self.known)] = 0
            here = self.known[at] == others if len(self.known) else np.zeros(len(others), bool)
            numbers = np.concatenate([numbers, at[here]])
            self.others.append(np.unique(others[~here]))
            self.size += len(self.others[-1])
        # Of equal numbers the last one written stays, and counts.
        places = np.arange(len(numbers))
        self.seen[numbers] = places
        self.counts[numbers[self.seen[numbers] == places]] += 1

    def batch(self, last: bool) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(self.others), return_counts=True) if self.others else (np.zeros(0, np.int64),) * 2
        self.others, self.size = [], 0
        if last:
            hit = np.flatnonzero(self.counts)
            pair, n = np.concatenate([pair, self.known[hit]]), np.concatenate([n, self.counts[hit]])
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(pair), f.type) for f in _DOC), pa.array(pair, pa.int64()), pa.array(n.astype(np.int64))], schema=_BOTH)


def _assembled(frequent):
    """Rows of two kinds: a document's sums, digest and rare segments; and pairs of ids with the documents of the task that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        texts, numbers, pairs, links, starts = frequent.value
        most, unpack, held, widths = len(texts), zstandard.ZstdDecompressor().decompress, Held(pairs), np.diff(starts)
        for batch in short(batches):
            rare = batch.column(3)
            at, info = (np.asarray(rare.offsets) - rare.offsets[0].as_py()).tolist(), rare.flatten()
            segs, told, sids = info.field("seg").to_pylist(), info.field("groups").to_pylist(), info.field("sid").to_numpy(zero_copy_only=False)
            own_links = info.field("links")
            own_at, own_flat = np.append(0, np.cumsum(own_links.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64).tolist(), np.asarray(own_links.flatten(), np.int64)
            # A group has a comma less than ids on either side, and a link less than ids.
            n_a, n_groups = info.field("n_a").to_numpy(zero_copy_only=False).astype(np.int64), np.array([(t or "").count(";") + 1 for t in told], np.int64)
            n_both = np.array([(t or "").count(",") for t in told], np.int64) + 2 * n_groups
            sums = np.stack([n_a, n_both - n_a, n_groups, n_both - n_groups], axis=1) if len(told) else np.zeros((0, 4), np.int64)
            n_sums, digests, own, own_n = np.zeros((batch.num_rows, 4), np.int64), [], [], []
            for r, code in enumerate(batch.column(2).to_pylist()):
                ids = unpacked(unpack(code))
                # Rare segments are numbered in their own order.
                order = sorted(range(at[r], at[r + 1]), key=segs.__getitem__)
                few = ids < most
                if order:
                    mine = [told[k] for k in order]
                    groups = [texts[i] if i < most else mine[i - most] for i in ids.tolist()]
                else:
                    groups = list(map(texts.__getitem__, ids.tolist()))
                if not groups or None in groups:
                    digests.append("")
                    own.append(())
                    own_n.append(())
                    continue
                digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest())
                common, times = ids[few], np.bincount(ids[~few] - most, minlength=len(order))
                n_sums[r] = numbers[common].sum(axis=0) + times @ sums[order]
                own.append(sids[order])
                own_n.append(times)
                # All links of the frequent segments: places in the list of links, one run after the other.
                common = np.unique(common)
                width = widths[common]
                ends = np.cumsum(width)
                runs = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[common] - ends + width, width)
                held.add(links[runs], np.concatenate([own_flat[own_at[k] : own_at[k + 1]] for k in order]) if order else np.zeros(0, np.int64))
            if held.size > FLUSH_PAIRS:
                yield held.batch(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(n_sums[:, k]) for k in range(4)), pa.array(digests, pa.string()), _lists(own, pa.int64()), _lists(own_n, pa.int32()), *(pa.nulls(batch.num_rows, pa.int64()) for _ in range(2))], schema=_BOTH)
        yield held.batch(True)

    return run


def _summed(sums):
    """(row, n_best, count_sum): what the frequent segments of a document come to; sums: both for each frequent segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        of_segment, unpack = sums.value, zstandard.ZstdDecompressor().decompress
        for batch in short(batches):
            found = np.zeros((batch.num_rows, 2), np.int64)
            for r, code in enumerate(batch.column(1).to_pylist()):
                ids = unpacked(unpack(code))
                found[r] = of_segment[ids[ids < len(of_segment)]].sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["row", "n_best", "count_sum"])

    return run


def aligned_documents(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    spark = docs.sparkSession
    bounded(spark)
    paths = (vocabulary_a or default_path("byte_bpe_50k.json"), vocabulary_b or default_path("piece_bpe_32k.model"))
    text = column(text_col)
    counted = docs.select(text.alias("text")).mapInArrow(_counted_segments(paths), "seg string, n bigint").groupBy("seg").agg(F.sum("n").alias("n"))
    encoded = staged(counted.mapInArrow(_encoded(paths), "sid bigint, seg string, n bigint, ok boolean, a array<int>, b array<int>"), "alignment-encoded")
    segments = staged(aligned_segments(encoded), "alignment-segments")

    least = _least_frequent(segments, most_frequent)
    # The most frequent first, so that codes are small numbers.
    top = segments.where(F.col("n") >= least).select("sid", "seg", "n", "groups", *_SUMS, "links").toArrow().sort_by([("n", "descending"), ("sid", "ascending")])
    links = top.column("links").combine_chunks()
    pairs, numbered = np.unique(np.asarray(links.flatten(), np.int64), return_inverse=True)
    starts = np.append(0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    known = spark.sparkContext.broadcast({s: k for k, s in enumerate(top.column("seg").to_pylist())})
    frequent = spark.sparkContext.broadcast((top.column("groups").to_pylist(), np.stack([top.column(c).to_numpy() for c in _SUMS], axis=1), pairs, numbered.astype(np.int32), starts))
    order = top.select(["sid"])
    del top, links

    coded = staged(docs.select(column(id_col).cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(_coded(paths, known), "row bigint, doc_id bigint, code binary, rare array<string>"), "alignment-codes")
    wanted = coded.select("row", F.explode("rare").alias("seg"))
    info = F.struct("seg", "sid", "groups", "n_a", "links")
    met = wanted.join(segments.where(F.col("n") < least).select("seg", "sid", "groups", "n_a", "links"), "seg").select("row", info.alias("info")).groupBy("row").agg(F.collect_list("info").alias("rare"))
    told = staged(coded.select("row", "doc_id", "code").join(met, "row", "left").select("row", "doc_id", "code", "rare").mapInArrow(_assembled(frequent), _BOTH_SQL), "alignment-documents")

    counts = told.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.shiftright("pair", B_BITS))
    counts = staged(counts, "alignment-pairs")
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    # One row for each id of A at most, so the vocabulary bounds it.
    judged = counts.join(F.broadcast(best), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("bigint").alias("best"))
    sums = staged(segments.select("sid", F.explode("links").alias("pair")).join(judged, "pair").groupBy("sid").agg(F.sum("best").alias("n_best"), F.sum("n_docs").alias("count_sum")), "alignment-sums")

    first = spark.createDataFrame(order.append_column("k", pa.array(np.arange(order.num_rows), pa.int64()))) if order.num_rows else spark.createDataFrame([], "sid bigint, k bigint")
    of_top = np.zeros((order.num_rows, 2), np.int64)
    for batch in sums.join(first, "sid").select("k", "n_best", "count_sum").toArrow().to_batches():
        of_top[batch.column(0).to_numpy()] = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
    common = coded.select("row", "code").mapInArrow(_summed(spark.sparkContext.broadcast(of_top)), "row bigint, n_best bigint, count_sum bigint")
    rows = told.where("row is not null").drop("pair", "n_docs")
    few = rows.select("row", F.explode(F.arrays_zip(F.col("rare").alias("sid"), F.col("rare_n").alias("times"))).alias("r")).select("row", "r.sid", "r.times")
    more = few.join(sums, "sid").select("row", (F.col("n_best") * F.col("times")).alias("n_best"), (F.col("count_sum") * F.col("times")).alias("count_sum"))
    total = common.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    # Texts without tokens have no digest, and no sums.
    valid = lambda c: F.when(F.col("groups_sha256") != "", F.col(c)).otherwise(0).alias(c)
    return rows.drop("rare", "rare_n").join(total, "row").select("doc_id", *_SUMS, valid("n_best"), valid("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))
