"""Language ID, source mixing and the pipeline."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillstone.llm.byte_gru import ByteGru
from quillstone.llm.language_id import fit, op3_language_id, pooled, training_sample, with_language
from quillstone.llm.mixing import SOURCES, WEIGHTS, budgets, domain_of_source, mixed, op10_source_mixing
from quillstone.llm.vocab import ByteBpe, default_path, loaded
from tests.llm.test_pairs import brute_ngram, edits, roots_of

MIDDLE = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_gradients_are_those_of_finite_differences():
    net = ByteGru(3, hidden=3, seed=1, dtype=np.float64)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.loss_and_gradients(x, y)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for i in rng.choice(np.flatnonzero(g[name].reshape(-1)), 5):
            old, e = flat[i], 1e-6
            flat[i] = old + e
            up, _ = net.loss_and_gradients(x, y)
            flat[i] = old - e
            down, _ = net.loss_and_gradients(x, y)
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 1e-6


def test_forward_equals_the_states_of_training():
    net = ByteGru(4, hidden=5, seed=3, dtype=np.float64)
    x = np.random.default_rng(1).integers(0, 256, (7, 9)).astype(np.uint8)
    assert np.allclose(net.forward(x), net.states(x))


def test_pooling_counts_every_letter_of_whole_texts():
    net = ByteGru(2, seed=1)
    texts = [b"abc" * 400, b"xyz", b"q" * 1000]
    whole = pooled(net, texts, window=50, halo=16)
    alone = np.concatenate([pooled(net, [t], window=50, halo=16) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5) and np.allclose(whole.sum(axis=1), 1, atol=1e-4)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = op3_language_id(spark, MIDDLE).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    told = [r for r in rows if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in told]) > 0.9


def test_language_edge_rows_and_no_leak(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(400)
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "12 34 !!", "xx", "s", 0), (None, "das ist ein Haus", None, None, 0), (-5, "wort " * 60_000, None, "s", 0)], DOCS)
    out = {r.doc_id: r for r in with_language(docs.unionByName(odd)).select("doc_id", "language.*").collect()}
    assert all(out[d].lang_pred == "und" and out[d].score == 0 for d in (-1, -2, -3))
    assert out[None].lang_pred != "und" and out[-5].lang_pred != "und"
    sample = training_sample(docs, "doc_id", "text", "lang", 3, 2)
    assert sample.groupby("lang").size().max() <= 6
    none = with_language(odd.where("doc_id = -5 or doc_id is null")).select("doc_id", "language.*").collect()
    assert all(r.lang_pred == "und" for r in none), "nothing to learn from"
    assert with_language(spark.createDataFrame([], DOCS)).count() == 0
    assert fit(sample.iloc[:0]) is None


# Mixing.


def plain_split(amount, children):
    """children: name -> (weight, most). Who takes all it can is found by trial, the rest is shared and rounded."""
    out = dict.fromkeys(children, 0)
    live = {n: (Fraction(str(w)), m) for n, (w, m) in children.items() if w > 0 and m > 0}
    while live:
        total = sum(w for w, _ in live.values())
        full = [n for n, (w, m) in live.items() if amount * w / total >= m]
        if not full:
            shares = {n: amount * w / total for n, (w, _) in live.items()}
            out |= {n: int(x) for n, x in shares.items()}
            for n in sorted(shares, key=lambda n: (int(shares[n]) - shares[n], n))[: amount - sum(int(x) for x in shares.values())]:
                out[n] += 1
            break
        for n in full:
            out[n] = live.pop(n)[1]
            amount -= out[n]
    return out


def plain_budgets(leaves, weights, total, epochs):
    def most(path):
        if weights.get(path, 1.0) <= 0 and path:
            return 0
        if len(path) == 3:
            return leaves[path] * epochs
        return sum(most(c) for c in {p[: len(path) + 1] for p in leaves if p[: len(path)] == path})

    out = {}

    def down(path, amount):
        if len(path) == 3:
            out[path] = amount
            return
        children = {p[: len(path) + 1] for p in leaves if p[: len(path)] == path}
        for child, given in plain_split(amount, {c: (weights.get(c, 1.0), most(c)) for c in children}).items():
            down(child, given)

    down((), min(total, most(())))
    return out


def spark_budgets(spark, leaves, weights, total, epochs):
    rows = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, lang string, source string, tokens bigint")
    return {(r.domain, r.lang, r.source): r.budget for r in budgets(rows, weights, total, epochs).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = {("a", "x", "s"): 10, ("a", "y", "s"): 100, ("b", "z", "s"): 1000}
    assert list(spark_budgets(spark, leaves, {}, 100, 1).values()) == [10, 40, 50]
    assert list(spark_budgets(spark, leaves, {}, 400, 1).values()) == [10, 100, 290]
    assert sum(spark_budgets(spark, leaves, {}, 10**6, 2).values()) == 2220


def test_children_of_weight_zero_count_nowhere(spark):
    leaves = {("a", "en", "s"): 100, ("a", "fr", "s"): 900, ("b", "en", "s"): 1000}
    assert spark_budgets(spark, leaves, {("a", "fr"): 0.0}, 1000, 1) == {("a", "en", "s"): 100, ("a", "fr", "s"): 0, ("b", "en", "s"): 900}
    assert spark_budgets(spark, leaves, {("a",): 0.0}, 5000, 1) == {("a", "en", "s"): 0, ("a", "fr", "s"): 0, ("b", "en", "s"): 1000}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_are_those_of_plain_fractions(spark, seed):
    """Random trees, weights with decimals and zeros, and token counts beyond the whole numbers of doubles."""
    rng = random.Random(seed)
    scale = (1, 1000, 10**16)[seed]
    leaves = {(f"d{i}", f"l{j}", f"s{k}"): rng.randint(0, 9) * scale + rng.randint(0, 9) for i in range(3) for j in range(rng.randint(1, 3)) for k in range(rng.randint(1, 4))}
    weights = {p[:d]: rng.choice([0.0, 0.25, 1.0, 1.5, 3.333333]) for p in leaves for d in (1, 2, 3)}
    for share in (3, 10):
        total = sum(leaves.values()) * share // 10
        assert spark_budgets(spark, leaves, weights, total, 2) == plain_budgets(leaves, weights, total, 2)


def plain_mixture(spark, docs, weights, share, epochs, seed):
    """(copies by doc_id, budgets and tokens by leaf): each leaf sorted whole, its epochs walked one by one."""
    enc = loaded(ByteBpe, default_path("byte_bpe_50k.json"))
    domain = {s: d for d, ss in SOURCES.items() for s in ss}
    leaves = {}
    for r in docs.withColumn("u", F.xxhash64("doc_id", "text")).collect():
        leaves.setdefault((domain.get(r.source, "other"), r.lang or "", r.source or ""), []).append((r.u, r.doc_id, len(enc.ids(r.text or ""))))
    sums = {p: sum(n for _, _, n in rows) for p, rows in leaves.items()}
    given = plain_budgets(sums, weights, int(sum(sums.values()) * Fraction(str(share))), epochs)
    keys = spark.createDataFrame([(u, w) for rows in leaves.values() for u, _, _ in rows for w in range(epochs + 1)], "u bigint, w int")
    key = {(r.u, r.w): r.k for r in keys.select("u", "w", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "w", "u"), 1).alias("k")).collect()}
    want = {}
    for p, rows in leaves.items():
        left, epoch = given[p], 0
        while sums[p] and left >= sums[p]:
            left, epoch = left - sums[p], epoch + 1
            for _, d, _ in rows:
                want[d] = want.get(d, 0) + 1
        for u, d, n in sorted(rows, key=lambda r: key[r[0], epoch]) if left else []:
            left -= n
            if left < 0:
                break
            want[d] = want.get(d, 0) + 1
    return want, given, sums


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.7, 2), (1.0, 3)])
def test_mixed_documents_are_those_of_sorted_leaves(spark, share, epochs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = WEIGHTS | {("web", "fr"): 0.0, ("books",): 0.5}
    want, given, sums = plain_mixture(spark, docs, weights, share, epochs, 17)
    chosen = mixed(docs.repartition(7), domain_of_source, weights, share, epochs, 17).collect()
    assert {r.doc_id: r.copies for r in chosen if sums[r.domain, r.lang or "", r.source or ""]} == want
    assert all(r.leaf_budget == given[r.domain, r.lang or "", r.source or ""] for r in chosen)


def test_mixing_edge_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "", 0), (3, "a b c", "en", "s1", 5), (3, "a b c", "en", "s1", 5), (None, "d e", "fr", None, 3)]
    out = mixed(spark.createDataFrame(rows, DOCS), domain_of_source, WEIGHTS, 1.0).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in out) == [(0, 2), (1, 0), (2, 0), (3, 3), (3, 3)]
    assert mixed(spark.createDataFrame([], DOCS), domain_of_source, WEIGHTS, 0.5).count() == 0
    assert op10_source_mixing(spark, SMALL).count() > 0


CLASHING = ["removed", "n_lines", "_k", "_whole", "_tokens", "_u", "_copies", "_key", "_language", "language", "_before", "drop", "_d", "part", "d", "u", "k", "doc", "tokens", "copies", "domain", "leaf_budget", "key", "h", "line", "words", "_maybe", "_slot", "component_id", "n", "blk", "a.b", "a`b"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_carry_columns_of_any_name(spark, name):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    docs = base.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    stage = dict(P.STAGES)[name]
    out = stage(spark, docs, SMALL)
    rows, plain = out.collect(), stage(spark, docs.select(*base.columns), SMALL).collect()
    assert len(rows) == len(plain)
    if name != "packing":
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)


def test_ngram_stage_judges_rows_by_id_and_text(spark):
    one, two = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(1, one), (1, two), (1, one), (2, one + " more"), (None, two + " more"), (None, "something else that nobody wrote before here"), (5, None), (6, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    left = sorted(((r.doc_id, r.text) for r in P.ngram_stage(spark, docs, SMALL).collect()), key=str)
    assert left == sorted([(1, one), (1, two), (None, rows[5][1]), (5, None), (6, ""), (7, None)], key=str)


# The pipeline.


def test_stages_keep_clean_documents_and_drop_what_they_should(spark):
    base = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("length(text) > 200").limit(300)
    known = base.collect()
    extra = [(10**6, known[0].text, known[0].lang, known[0].source, known[0].n_chars), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "0 1 2 3", "en", "s", 7)]
    docs = base.unionByName(spark.createDataFrame(extra, DOCS))
    for name, stage in P.STAGES:
        out = stage(spark, docs, MIDDLE)
        if name != "packing":
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {10**6 + 1, 10**6 + 2} and len(ids) >= 0.97 * len(known)
        if name in ("line_dedup", "ngram_join"):
            assert 10**6 not in ids or known[0].doc_id not in ids
        if name != "packing":
            docs = spark.createDataFrame(out.collect(), docs.schema)


def plain_lines(rows):
    """Texts by doc_id without repeated and similar lines: every pair of lines is compared."""
    words = lambda line: tuple(regex.findall(r"[\p{L}\p{N}\p{M}]+", line.lower()))
    first, where = {}, {}
    for d, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            w = words(line)
            if w:
                first.setdefault(w, (d, pos))
                where.setdefault(w, []).append((d, pos))
    nodes = sorted(first, key=first.get)
    bags = {w: set(w) for w in nodes}
    links = []
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            most = max(len(a), len(b)) // 5
            if min(len(a), len(b)) >= max(5, max(len(a), len(b)) - most) and len(bags[a] - bags[b]) <= most and len(bags[b] - bags[a]) <= most and edits(a, b) <= most:
                links.append((first[a], first[b]))
    top = roots_of(sorted(first.values()), links)
    gone = {at for w, places in where.items() for at in places if at != top[first[w]]}
    return {d: "\n".join(line for pos, line in enumerate(text.split("\n")) if (d, pos) not in gone) for d, text in rows}


def test_stages_equal_plain_versions(spark):
    """Line dedup, n-gram join and mixing, one after the other, against every pair compared and every leaf sorted."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    before = {r.doc_id: r.text for r in docs.collect()}
    want = plain_lines(list(before.items()))
    want = {d: t for d, t in want.items() if t == before[d] or regex.search(r"[\p{L}\p{N}]", t)}
    lined = P.line_stage(spark, docs, SMALL)
    assert {r.doc_id: r.text for r in lined.collect()} == want
    lined = spark.createDataFrame(lined.collect(), docs.schema)
    groups = brute_ngram(list(want.items()), 5, 80)
    joined = P.ngram_stage(spark, lined, SMALL)
    assert {r.doc_id for r in joined.collect()} == {d for d, (_, top) in groups.items() if top == d}
    joined = spark.createDataFrame(joined.collect(), docs.schema)
    copies, _, sums = plain_mixture(spark, joined, WEIGHTS, P.SHARE, P.EPOCHS, P.SEED)
    assert all(sums.values()) and {r.doc_id for r in P.mixing_stage(spark, joined, SMALL).collect()} == set(copies)


def test_line_stage_keeps_what_is_nowhere_else(spark):
    shared = "\n".join(f"passage {i} that two documents share word for word {i}" for i in range(30))
    rows = [(1, shared, "en", "s", len(shared)), (2, f"{shared}\nonly here", "en", "s", len(shared) + 10), (3, f"{shared}\n---", "en", "s", len(shared) + 4)]
    left = {r.doc_id: (r.text, r.n_chars) for r in P.line_stage(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()}
    assert left[2] == ("only here", 9) and set(left) == {1, 2}


def test_training_sample_takes_equal_texts_once(spark):
    rows = [(i, f"text number {i if i < 60 else 'again'}", "en") for i in range(3000)]
    sample = training_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", 40, 1)
    assert len(sample) == 40 == sample["piece"].nunique()


def test_stages_take_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_pipeline_runs_whole(spark):
    rows = P.run(spark, SMALL).collect()
    assert rows and {r.sequence_id for r in rows} == set(range(max(r.sequence_id for r in rows) + 1))
    assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in rows)
