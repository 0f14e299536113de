"""N-gram Jaccard join by prefix trees, and the components of its links.

Documents are sets of word n-grams; two link when 100 * intersection >= threshold * union.

1. One pass over the texts makes, for each block of an Arrow batch, its postings (n-gram hash, document)
   packed into one row per hash range. A task for each range counts the documents of every n-gram and sends
   back what is shared. A document with more n-grams of its own than a link allows (1 - t of its set) is
   done: it links with nothing. An n-gram that is common within a block is counted there: its range gets one
   number for it, and its documents go past the count to the block, so no task holds a row for each document
   of an n-gram that is everywhere.
2. What is left is ordered globally, rare n-grams first. Linked sets share an n-gram among the first
   n - ceil(t n) + 1 of each. Each such n-gram names a pivot, the holder that has the fewest n-grams of its
   own; a document meets all its candidates in the buckets of its pivots, so a set is sent once for each
   pivot, not for each n-gram.
3. Buckets are dealt out in chunks. In a chunk the sets, read frequent n-grams first, form a trie whose
   paths share partial overlaps; all probes go down together and leave a subtree once the n-grams that
   remain can't make up the overlap needed. A chunk yields spanning links, not pairs.
4. In a bucket of several chunks the members joined to the pivot need no comparison with one another. The
   rest are compared with all members of the bucket outside their component, block by block.

Null texts and texts without words have an empty set and link with nothing. Repeated rows and equal sets
form one node; rows that repeat a doc_id are one document. A null doc_id has a null component. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, short, staged, table
from quillstone.llm.components import components
from quillstone.llm.shingles import mix, shingle_sets

#: Documents of a block (of at most 1000) from which on an n-gram is common there.
COMMON = 32
#: Bytes of text for each hash range; a range's postings are some twice that.
RANGE_BYTES = 8 << 20
#: Sets and n-grams that a chunk of a bucket holds.
CHUNK_SETS, CHUNK_GRAMS = 256, 1 << 19

_POSTINGS = "bucket int, blk bigint, kind int, docs binary, hashes binary, extra binary"
_SHARED = "blk bigint, kind int, docs binary, hashes binary, extra binary"
_NODES = "doc_id bigint, n bigint, k1 bigint, k2 bigint, own bigint, prefix array<bigint>, grams binary, classes binary"
_LINKS = "a bigint, b bigint"


def _planes(x: np.ndarray) -> bytes:
    """Bytes plane by plane: the leading planes of sorted numbers shrink to nothing in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _dealt(buckets: int, hashes: np.ndarray, beside: np.ndarray) -> list[tuple]:
    """(range, hashes, beside) of sorted hashes for each range that has any."""
    cuts = np.searchsorted(hashes, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)).tolist()
    return [(k, hashes[a:b], beside[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)) if b > a]


def _postings(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _POSTINGS.split(", ")]
        for batch in short(batches):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column(1), width)
                n = np.array([len(s) for s in sets], np.int64)
                ids = part.column(0)
                known = np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool)
                id_values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.array([[(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)] if len(s) else [0, 0] for s in sets], np.uint64)
                meta = np.concatenate([id_values, known.astype(np.int64), n, keys[:, 0].view(np.int64), keys[:, 1].view(np.int64)]).tobytes()
                blk = int.from_bytes(hashlib.blake2b(meta, digest_size=8).digest(), "little", signed=True)
                rows = [(blk % buckets, blk, 0, None, None, meta)]
                hashes = np.concatenate(sets)
                docs = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
                order = np.argsort(hashes, kind="stable")
                hashes, docs = hashes[order], docs[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                each = np.diff(np.append(first, len(hashes)))
                often = each >= COMMON
                if often.any():
                    passed = np.repeat(often, each)
                    rows.append((blk % buckets, blk, 3, _planes(docs[passed]), _planes(hashes[passed]), None))
                    rows += [(k, blk, 2, None, _planes(h), c.tobytes()) for k, h, c in _dealt(buckets, hashes[first[often]], each[often].astype(np.uint16))]
                    hashes, docs = hashes[~passed], docs[~passed]
                rows += [(k, blk, 1, _planes(d), _planes(h), None) for k, h, d in _dealt(buckets, hashes, docs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    return run


def _count(group: pa.Table) -> pa.Table:
    """The postings of a hash range: of each n-gram that several documents hold, the class of its count, sent back to its blocks.

    Kinds: 0 a block's description and 3 the documents of what is common there, both handed on; 1 postings; 2 counts of what is common in a block.
    """
    kinds, blks = group.column("kind").to_pylist(), group.column("blk").to_pylist()
    every = list(zip(kinds, blks, *(group.column(c).to_pylist() for c in ("docs", "hashes", "extra")), strict=True))
    out = [(b, k, d, h, x) for k, b, d, h, x in every if k in (0, 3)]
    rows = [r for r in every if r[0] in (1, 2)]
    if rows:
        parts, counted = [_unplanes(r[3], np.uint64) for r in rows], []
        for r, h in zip(rows, parts, strict=True):
            if r[0] == 2:
                counted.append((h, np.frombuffer(r[4], np.uint16).astype(np.int64)))
            else:
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                counted.append((h[first], np.diff(np.append(first, len(h)))))
        hashes, each = (np.concatenate(side) for side in zip(*counted, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, each = hashes[order], each[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.add.reduceat(each, first)
        shared, counts = hashes[first][counts > 1], counts[counts > 1]
        classes = np.minimum(np.ceil(np.log2(counts)), 255).astype(np.uint8)
        for (kind, blk, docs, _, _), h in zip(rows, parts, strict=True):
            if not len(shared):
                break
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            keep = shared[at] == h
            if keep.any():
                out.append((blk, kind, _planes(_unplanes(docs, np.uint16)[keep]) if kind == 1 else None, _planes(h[keep]), classes[at[keep]].tobytes()))
    cols = list(zip(*out, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["blk", "kind", "docs", "hashes", "extra"])


def _nodes(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        """All documents of a block; of those that may link, the shared n-grams, rare ones first."""
        rows = group.to_pylist()
        # Blocks of equal content share a key: each description is one copy of the block, and the postings arrived once for each.
        metas = [r["extra"] for r in rows if r["kind"] == 0]
        seen: dict[bytes, dict] = {}
        for r in rows:
            if r["kind"] == 1:
                seen.setdefault(r["hashes"], r)
        meta = np.frombuffer(metas[0], np.int64).reshape(5, -1)
        ids, known, n, k1, k2 = meta
        shared = list(seen.values())
        docs = [_unplanes(r["docs"], np.uint16) for r in shared]
        hashes = [_unplanes(r["hashes"], np.uint64) for r in shared]
        classes = [np.frombuffer(r["extra"], np.uint8) for r in shared]
        common = next((r for r in rows if r["kind"] == 3), None)
        if common:
            counted = {r["hashes"]: r for r in rows if r["kind"] == 2}.values()
            known_hashes = np.concatenate([_unplanes(r["hashes"], np.uint64) for r in counted])
            order = np.argsort(known_hashes)
            h = _unplanes(common["hashes"], np.uint64)
            docs.append(_unplanes(common["docs"], np.uint16))
            hashes.append(h)
            classes.append(np.concatenate([np.frombuffer(r["extra"], np.uint8) for r in counted])[order][np.searchsorted(known_hashes[order], h)])
        docs, hashes, classes = (np.concatenate([np.zeros(0, t), *side]) for side, t in ((docs, np.uint16), (hashes, np.uint64), (classes, np.uint8)))
        order = np.lexsort((hashes, classes, docs))
        docs, hashes, classes = docs[order], hashes[order], classes[order]
        ends = np.searchsorted(docs, np.arange(len(n) + 1))
        own, prefix, grams, kinds = [], [], [], []
        for i in range(len(n)):
            h, c = hashes[ends[i] : ends[i + 1]], classes[ends[i] : ends[i + 1]]
            need = -(-int(n[i]) * threshold // 100)
            alone = int(n[i]) - len(h)
            own.append(alone)
            if not known[i] or not n[i] or len(h) < need:
                prefix.append(None), grams.append(None), kinds.append(None)
                continue
            prefix.append(h[: int(n[i]) - need + 1 - alone].view(np.int64).tolist())
            grams.append(h.tobytes()), kinds.append(c.tobytes())
        out = pa.Table.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(n), pa.array(k1), pa.array(k2), pa.array(own, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(grams, pa.binary()), pa.array(kinds, pa.binary())], ["doc_id", "n", "k1", "k2", "own", "prefix", "grams", "classes"])
        return pa.concat_tables([out] * len(metas))

    return run


class Trie:
    """Sets in one global order as a trie; it is never built node by node but read off the sorted sequences."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.seqs, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)

    def links(self, member: np.ndarray, probe_sizes: np.ndarray, threshold: int, slice_len: int = 64) -> Iterator[tuple[int, np.ndarray]]:
        """member: for each n-gram's rank and probe, whether the probe holds it. Yields each set's index with the probes linked to it."""
        held = member.sum(axis=0, dtype=np.int64)
        stack = [(0, len(self.seqs), 0, np.zeros(len(probe_sizes), np.int64), np.arange(len(probe_sizes)))]
        while stack:
            lo, hi, depth, overlap, alive = stack.pop()
            a, b = self.seqs[lo], self.seqs[hi - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            longest, least = int(self.lengths[lo:hi].max()), int(self.sizes[lo:hi].min())
            need = -(-threshold * (probe_sizes[alive] + least) // (100 + threshold))
            while True:
                keep = np.minimum(overlap + (longest - depth), held[alive]) >= need
                if not keep.all():
                    overlap, alive, need = overlap[keep], alive[keep], need[keep]
                if depth == end or not len(alive):
                    break
                step = min(end, depth + slice_len)
                overlap = overlap + member[a[depth:step]][:, alive].sum(axis=0, dtype=np.int64)
                depth = step
            if not len(alive):
                continue
            at = lo
            while at < hi and self.lengths[at] == depth:  # sorted first: sets that end here
                ok = (100 + threshold) * overlap >= threshold * (probe_sizes[alive] + self.sizes[at])
                yield self.order[at], alive[ok]
                at += 1
            heads = np.array([self.seqs[i][depth] for i in range(at, hi)])
            for x in np.split(np.arange(at, hi), np.flatnonzero(heads[1:] != heads[:-1]) + 1) if len(heads) else []:
                stack.append((int(x[0]), int(x[-1]) + 1, depth, overlap, alive))


def _ranked(rows: list[dict]) -> tuple[list[np.ndarray], int]:
    """Each set as ranks in the global order read from its frequent end, without n-grams that one set alone holds here."""
    grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    classes = [np.frombuffer(r["classes"], np.uint8) for r in rows]
    every, kind = np.concatenate(grams), np.concatenate(classes)
    uniq, first, inverse, counts = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((uniq, -kind[first].astype(np.int64)))
    order = order[counts[order] > 1]
    rank = np.full(len(uniq), -1, np.int64)
    rank[order] = np.arange(len(order))
    out, at = [], 0
    for g in grams:
        r = rank[inverse[at : at + len(g)]]
        out.append(np.sort(r[r >= 0]))
        at += len(g)
    return out, len(order)


def _membership(sets: list[np.ndarray], universe: int) -> np.ndarray:
    member = np.zeros((universe, len(sets)), np.bool_)
    for j, s in enumerate(sets):
        member[s, j] = True
    return member


def _linked(rows: list[dict], probes: list[dict], threshold: int) -> Iterator[tuple[dict, np.ndarray]]:
    sets, universe = _ranked(rows + probes)
    member = _membership(sets[len(rows) :], universe)
    trie = Trie(sets[: len(rows)], np.array([r["n"] for r in rows], np.int64))
    sizes = np.array([r["n"] for r in probes], np.int64)
    for i, found in trie.links(member, sizes, threshold):
        yield i, found


def _self_join(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        """The links within a chunk, as a forest that spans its components."""
        rows = list({(r["doc_id"], r["grams"]): r for r in group.to_pylist()}.values())
        top = list(range(len(rows)))

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        ids = [r["doc_id"] for r in rows]
        for i, found in _linked(rows, rows, threshold) if len(rows) > 1 else ():
            for j in found.tolist():
                x, y = root(i), root(j)
                if x != y:
                    top[max(x, y, key=ids.__getitem__)] = min(x, y, key=ids.__getitem__)
        pairs = [(ids[i], ids[root(i)]) for i in range(len(rows)) if ids[root(i)] != ids[i]]
        a, b = zip(*pairs, strict=True) if pairs else ([], [])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _block_join(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between what isn't joined to the pivot and other members; one link for each of the other's components is enough."""
        rows = group.to_pylist()
        probes, members = [r for r in rows if r["probe"]], [r for r in rows if not r["probe"]]
        found_links = set()
        if probes and members:
            for i, found in _linked(members, probes, threshold):
                found_links |= {(probes[j]["label"], members[i]["label"]) for j in found.tolist() if probes[j]["label"] != members[i]["label"]}
        a, b = zip(*found_links, strict=True) if found_links else ([], [])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def ngram_nodes(docs: DataFrame, width: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Steps 1 and 2: every document with its set's size and key, and the shared n-grams of those that may link."""
    spark = docs.sparkSession
    bounded(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    packed = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_postings(width, buckets), _POSTINGS)
    shared = packed.groupBy("bucket").applyInArrow(_count, _SHARED)
    return shared.groupBy("blk").applyInArrow(_nodes(threshold), _NODES)


def ngram_components(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; threshold in hundredths."""
    nodes = staged(ngram_nodes(docs, width, threshold, id_col, text_col), "ngram-nodes")
    # Written before it is joined, so that a large group of equal sets can be split among tasks.
    first = staged(nodes.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "ngram-equal")
    known = staged(nodes.select("doc_id", "n", "k1", "k2").join(first, ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "ngram-reps")
    reps = known.where("doc_id = rep").select("doc_id").distinct()
    sets = staged(nodes.where("grams is not null").join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "k1", "k2"]).drop("k1", "k2"), "ngram-sets")

    held = sets.select("doc_id", "own", F.explode("prefix").alias("gram"))
    pivots = staged(held.groupBy("gram").agg(F.min(F.struct("own", "doc_id")).alias("pivot"), F.count("*").alias("c")).where("c > 1").select("gram", F.col("pivot.doc_id").alias("v")), "ngram-pivots")
    met = staged(held.join(pivots, "gram").select("doc_id", "v").distinct(), "ngram-met")
    sizes = sets.select("doc_id", "n")
    chunks = met.join(sizes, "doc_id").groupBy("v").agg(F.count("*").alias("c"), F.sum("n").alias("grams")).select("v", F.greatest(F.ceil(F.col("c") / CHUNK_SETS), F.ceil(F.col("grams") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    dealt = met.join(chunks, "v").select("v", "doc_id", F.when(F.col("v") != F.col("doc_id"), F.array(F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")).select("v", "doc_id", F.explode("k").alias("k"))
    shipped = dealt.join(sets.select("doc_id", "n", "grams", "classes"), "doc_id")
    edges = staged(shipped.groupBy("v", "k").applyInArrow(_self_join(threshold), _LINKS).distinct(), "ngram-links")
    roots = components(edges)

    wide = met.join(chunks.where("chunks > 1"), "v")
    label = F.coalesce("root", "doc_id").alias("label")
    labelled = wide.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("v", "chunks", "doc_id", label)
    hub = wide.select(F.col("v").alias("doc_id")).distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.col("doc_id").alias("v"), F.coalesce("root", "doc_id").alias("hub"))
    labelled = staged(labelled.join(hub, "v").select("v", "chunks", "doc_id", "label", (F.col("label") != F.col("hub")).alias("rest")), "ngram-rest")
    blocks = labelled.where("rest").groupBy("v").agg(F.ceil(F.count("*") / (CHUNK_SETS // 2)).cast("int").alias("blocks"))
    if blocks.head(1):
        both = labelled.join(blocks, "v")
        place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        probes = both.where("rest").select("v", "doc_id", "label", F.lit(True).alias("probe"), place("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
        others = both.select("v", "doc_id", "label", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), place("chunks").alias("j"))
        pairs = probes.unionByName(others).join(sets.select("doc_id", "n", "grams", "classes"), "doc_id")
        more = staged(pairs.groupBy("v", "i", "j").applyInArrow(_block_join(threshold), _LINKS).distinct(), "ngram-more")
        if more.head(1):
            roots = components(edges.unionByName(more))
    return known.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=4, threshold=85)


#: Every pair of documents that share a shingle: fit for the small tables of the comparison only.
SQL = r"""WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s FROM w, unnest(range(1, greatest(2, len(w) - 2))) AS u(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS rep FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS whole FROM s GROUP BY 1)),
    r AS (SELECT s.* FROM s JOIN same USING (doc_id) WHERE doc_id = rep),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c AS (SELECT rep AS node, rep AS dest FROM same UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.dest),
    root AS (SELECT node, min(dest) AS root FROM c GROUP BY 1)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN root ON root.node = same.rep"""
