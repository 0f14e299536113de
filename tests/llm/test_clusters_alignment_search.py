"""Exponion clusters, aligned tokens and metric trees against brute force."""

import bisect
import collections
import hashlib
import math

import numpy as np
import pytest

from quillstone.llm import metric_tree
from quillstone.llm.exponion import EXACT, LARGEST, Centroids, clustered, exponion, squared
from quillstone.llm.metric_tree import Tree, built, top_products
from quillstone.llm.token_alignment import Aligned, aligned_documents
from quillstone.llm.vocab import default_path

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "x▁y ok", "word,next (abc) 's don't", "a\t b\r\n c;\r d", "漢字かな 混じり。text、word", "  two\n\n three  ", "\n", "nul\0x", "<|endoftext|> <s> a<0x0A>", "é é ﬁ  nb　全", "Straße,ünïts1234abc!!##", "!!!###$$$%%%^&*()", "αβγ, δε abc漢,abcω,", "😀a😀 ,b", "a-b_c d.e" * 50, "x" * 3000, "a\x85 b \xa0c­ d"]


# Tokens of two tokenizers


def plain_alignment(al, text):
    if not text:
        return None
    a, b = al.a.tok.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    raw = [[al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, (ids, at) in enumerate(zip((a, b), ends, strict=True)):
        for i, e in zip(ids, at, strict=True):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    spans = [list(zip(ids, [0, *at], at, strict=False)) for ids, at in zip((a, b), ends, strict=True)]
    links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1][max(0, bisect.bisect_left(ends[1], s) - 1) : bisect.bisect_left(ends[1], e) + 1] if s < f and t < e]
    return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def plain_alignments(rows):
    al = Aligned((default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")))
    assert al.cuts
    found = [plain_alignment(al, t) for t in rows]
    counts = collections.Counter(p for v in found if v for p in set(v[3]))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if v is None else (v[0], v[1], v[2], len(v[3]), sum(counts[p] == best[p[0]] for p in v[3]), sum(counts[p] for p in v[3]), v[4]) for v in found]


@pytest.mark.parametrize("most_frequent", [1, 300, 1 << 19])
def test_alignment_equals_all_overlaps(spark, most_frequent):
    """Whatever share of the segments is broadcast. Columns with the operator's own names don't matter."""
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    rows = [(k, t, 7, "x", None) for k, t in enumerate(texts)]
    out = aligned_documents(spark.createDataFrame(rows, "doc_id bigint, text string, row int, seg string, pair bigint"), most_frequent=most_frequent)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [got[k] for k in range(len(rows))] == plain_alignments(texts)


def test_alignment_of_repeats_nulls_and_empty_tables(spark):
    assert aligned_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "one text, twice"), (1, "one text, twice"), (None, "one text, twice"), (2, None), (2, "")]
    got = sorted((tuple(r) for r in aligned_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    want = plain_alignments([t for _, t in rows])
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=str)


def test_alignment_of_texts_that_end_in_a_blank(spark):
    texts = ["a ", "one, two ", "é ", "1 ", "a\n ", " ", "  ", "a  ", "漢 ", "a b", "x. "]
    out = aligned_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == plain_alignments(texts)


# Centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    vectors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in vectors if r[0] is not None), key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    points = [v for _, v in (order + [r for r in vectors if r[0] is None])[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        for c in range(len(points)):
            mine = [v for (_, v), o in zip(vectors, own, strict=True) if o == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in vectors]
    inertia = collections.Counter()
    for _, d, c in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, own int, x string"


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_clusters_equal_all_distances(spark, kind):
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=(300, 64)) * 0.2, "ties": rng.integers(0, 2, size=(300, 64)) * (rng.random((300, 64)) < 0.03) / 64, "few": rng.normal(size=(5, 64))}[kind]
    rows = [(k, v.tolist(), 0, 1, "y") for k, v in enumerate(x)]
    rows += [rows[0], rows[1], (None, x[2].tolist(), None, None, None), (900, None, 0, 0, ""), (901, [1.0] * 63, 0, 0, ""), (902, [1.0] * 63 + [float("nan")], 0, 0, ""), (903, [1.0] * 63 + [None], 0, 0, ""), (904, [1.0] * 63 + [float("inf")], 0, 0, ""), (905, [], 0, 0, "")]
    got = sorted(map(tuple, clustered(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == plain_clusters([r[:2] for r in rows])


def test_clusters_of_no_vectors_and_of_too_large_ones(spark):
    assert clustered(spark.createDataFrame([], VECTORS)).count() == 0
    assert clustered(spark.createDataFrame([(1, [1.0], 0, 0, "")], VECTORS)).count() == 0
    with pytest.raises(Exception, match="don't fit a long"):
        clustered(spark.createDataFrame([(1, [4e6] * 64, 0, 0, "")], VECTORS)).count()


@pytest.mark.parametrize("peak", [3, 300, EXACT + 1, LARGEST])
def test_bounds_never_hide_a_centroid(peak):
    """Round after round, with equal centroids and equal distances: all the nearest of smallest number, for fewer distances than all."""
    rng = np.random.default_rng(peak)
    x = rng.integers(-peak, peak + 1, size=(700, 8))
    x[:350] = np.clip(x[rng.integers(0, 12, 350)] + rng.integers(-max(1, peak // 40), max(1, peak // 40) + 1, size=(350, 8)), -peak, peak)
    points = x[rng.choice(700, 24)].copy()
    points[5] = points[3]
    own, upper, lower, before, taken = np.zeros(700, np.int64), np.full(700, np.inf), np.zeros(700), None, 0
    for _ in range(6):
        centroids = Centroids(points, before)
        own, upper, lower, n = centroids.assign(x, own, upper, lower)
        taken += n
        d = np.stack([((x - p) ** 2).sum(1) for p in points], axis=1)
        assert (squared(x, points) == d).all()
        assert (own == d.argmin(1)).all()
        before, points = points, np.array([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else points[c] for c in range(24)])
    assert taken < 6 * d.size


def test_one_centroid(spark):
    state, points = exponion(spark.createDataFrame([(k, [k / 64.0] * 64, 0, 0, "") for k in range(5)], VECTORS), k=1)
    assert points.tolist() == [[2] * 64] and state.count() == 5


# Exact top-k


def plain_top(rows, k=10, every=100):
    vectors = sorted({(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q in vectors:
        if q[0] % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q[1], v[1], strict=True)), v[0]) for v in vectors if v != q and len(v[1]) == len(q[1]))[:k]
            out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tree", [16_384, 40])
def test_top_k_equals_all_products(spark, monkeypatch, tree):
    """Copies of a query beyond k, ties, vectors of other lengths, shared ids; in one tree a region and in many."""
    monkeypatch.setattr(metric_tree, "TREE", tree)
    monkeypatch.setattr(metric_tree, "PIVOTS", 5 if tree == 40 else 256)
    monkeypatch.setattr(metric_tree, "BLOCK", 3 if tree == 40 else 512)
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=12) * rng.choice([0.1, 1, 5])).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[100][1]) for k in range(150)] + [(2000 + k, (rng.integers(-1, 2, size=4) * 1.0).tolist()) for k in range(300)]
    rows += [(200, [0.5] * 12), rows[300], (None, rows[5][1]), (3000, None), (3100, [None] * 12), (3200, [float("nan")] * 12), (3300, []), (3400, []), (3500, [7.0])]
    data = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "vec_id bigint, embedding array<float>, node int, region string, score int")
    out = top_products(data)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == plain_top(rows)


def test_top_k_of_nothing_and_of_few(spark):
    assert top_products(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(100, [1.0, 2.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in top_products(few).collect()] == [(100, 1, 1, 2 << 20)]
    with pytest.raises(Exception, match="don't fit a long"):
        top_products(spark.createDataFrame([(100, [1e30])], "vec_id bigint, embedding array<double>")).count()


@pytest.mark.parametrize("page", [2, 7, 96])
def test_tree_leaves_out_pages_but_no_vector(page):
    rng = np.random.default_rng(page)
    centers = rng.integers(-900, 900, size=(20, 16))
    x = (centers[rng.integers(0, 20, 2000)] + rng.integers(-20, 21, size=(2000, 16))).astype(np.int64)
    x[1500:1700] = x[3]
    most = float((x * x).sum(1).max())
    pages = built(x, most, page)
    # The tree's rows as they are stored: page after page, with an id for each.
    order = np.concatenate([p.entries for p in pages])
    at = 0
    ids = []
    for p in pages:
        ids += [[int(e)] if p.below is None else [] for e in p.entries]
        p.entries = np.arange(at, at + len(p.entries))
        at += len(p.entries)
    tree = Tree(pages, x[order], ids, most)
    assert sorted(i for own in ids for i in own) == list(range(2000))
    for q in x[::97]:
        s = x @ q
        want = sorted(((int(v), i) for i, v in enumerate(s)), key=lambda h: (-h[0], h[1]))[:11]
        assert tree.search(q, 11) == want
        assert tree.search(q, 11, floor=want[-1][0]) == want
    if page == 7:
        assert tree.distances < len(x[::97]) * 2 * 2000 * 0.7
