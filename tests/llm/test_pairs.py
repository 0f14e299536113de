"""N-gram join, embeddings, components and line dedup against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import embedding_dedup
from quillstone.llm.components import components
from quillstone.llm.embedding_dedup import embedding_links, hadamard
from quillstone.llm.line_dedup import dedup_lines, op8_line_dedup
from quillstone.llm.ngram_join import Trie, ngram_components, op1_ngram_jaccard_join

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def roots_of(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_ngram(rows, width, threshold):
    sets = {d: shingles(t, width) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    top = roots_of(sets, links)
    return {d: (len(sets[d]), top[d]) for d in sets}


def made_texts(seed, groups=12, each=9, words=40):
    """Groups of copies whose edits drift, so that some link only through others."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(each):
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width,threshold,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_ngram_components_equal_brute_force(spark, width, threshold, seed):
    rows = made_texts(seed)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, rows[0][1].upper()), (1007, rows[0][1])]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), width, threshold).collect()}
    assert found == brute_ngram(rows, width, threshold)


def test_ngram_query_on_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_jaccard_join(spark, SMALL).collect()}
    assert found == brute_ngram(rows, 4, 85)


def test_ngram_buckets_of_many_chunks(spark, monkeypatch):
    import quillstone.llm.ngram_join as module

    monkeypatch.setattr(module, "CHUNK_SETS", 8)
    rows = made_texts(5, groups=3, each=60)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    assert found == brute_ngram(rows, 4, 85)


def test_ngram_edge_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, "x " * 50_000)]
    out = ngram_components(spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, component_id string"), 4, 85).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (2, 5)} == {2}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert ngram_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_trie_finds_what_comparing_finds():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(5, 30)))) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    member = np.zeros((60, len(sets)), bool)
    for j, s in enumerate(sets):
        member[s, j] = True
    found = {(i, int(j)) for i, js in Trie(sets, sizes).links(member, sizes, 50, slice_len=3) for j in js}
    want = {(i, j) for i in range(80) for j in range(80) if 100 * len(set(sets[i]) & set(sets[j])) >= 50 * len(set(sets[i]) | set(sets[j]))}
    assert found == want


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(1, 1), (2, 2)] + [(400, 401), (401, 402), (402, 400)]
    found = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    nodes = {n for pair in links for n in pair}
    assert found == {n: r for n, r in roots_of(nodes, links).items() if n != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def test_embedding_links_are_right_and_recall_is_high(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    for i in range(150):  # planted near pairs
        v = np.array(rows[i][1])
        rows.append((10_000 + i, (v + rng.normal(0, 0.15, len(v)) * np.sqrt(v @ v / len(v))).tolist(), rows[i][2]))
    links = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and cosine(a[1], b[1]) >= 0.93]
    found = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    degree = dict.fromkeys(found, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(found[v].n_links <= degree[v] for v in degree)
    assert sum(r.n_links for r in found.values()) >= 0.9 * 2 * len(links) > 200
    want = roots_of(found, links)
    assert all(want[r.vec_id] == want[r.component_id] and r.kept == (r.vec_id == r.component_id) for r in found.values())


@pytest.mark.parametrize("bucket,hashes", [(1e-3, 3), (1e-5, 4)])
def test_recall_with_more_hashes(spark, monkeypatch, bucket, hashes):
    """The hashes that millions of vectors take, by a smaller BUCKET: at least 0.9 of all planted links, and a column of the operator's own name beside."""
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(hashes)
    base = rng.normal(size=(250, 64))
    near = base + rng.normal(size=base.shape) * 0.3
    rows = [(k, v.tolist(), 1, 5) for k, v in enumerate(np.concatenate([base, near]))]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node int")
    n = spark.range(1).select(embedding_dedup.hashes_of(F.lit(500), F.lit(64)).alias("n")).first().n
    assert n == hashes
    want = {(a, b) for a, b in itertools.combinations(range(500), 2) if cosine(rows[a][1], rows[b][1]) >= 0.93}
    found = {r.vec_id: r.n_links for r in embedding_links(data).collect()}
    degree = {k: sum(k in p for p in want) for k in found}
    assert all(found[k] <= degree[k] for k in found) and sum(found.values()) >= 0.9 * 2 * len(want) > 300


def test_embedding_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 2.0], 0), (9, [], 0), (10, [2.0, 4.0, 6.0], 0), (11, [1.0, 2.0], 0), (None, v, 0)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert {k: found[k] for k in (1, 2, 10)} == {1: (2, 1), 2: (2, 1), 10: (2, 1)}
    assert all(found[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 11)) and found[None] == (0, None)
    assert embedding_links(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0


def test_hadamard_keeps_lengths_apart_from_its_scale():
    x = np.random.default_rng(1).normal(size=(4, 64))
    assert np.allclose(hadamard(hadamard(x)), 64 * x)


def line_words(line):
    return [w for w in re.sub(r"[\W_]+", " ", line.lower()).strip().split(" ")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_exact_line_repeats_go_and_first_ones_stay(spark):
    a, b, c = "The quick brown fox jumps over dogs", "Every morning the kettle sings loudly", "short line here"
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}\n{a.upper()}!!"), (3, f"{c}\n{c}"), (4, None), (5, ""), (6, f"{a}\n{a}")]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, drop int")).collect()}
    assert out[1].text == f"{a}\n{b}" and out[1].removed == []
    assert out[2].text == c and out[2].removed == [0, 2]
    assert out[3].text == f"{c}\n{c}" and out[4].text is None and out[5].text == "" and out[4].n_lines == 0
    assert out[6].text == "" and out[6].removed == [0, 1] and out[6].drop == 1


def edited_lines(rng, least, most, shares, groups=40, size=60):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(size)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(least, most))]
        for share in shares:
            words = list(base)
            for _ in range(int(share * len(base) + 0.5)):
                at, how = rng.randrange(len(words)), rng.random()
                words[at : at + 1] = [] if how < 0.2 else [words[at], rng.choice(vocabulary)] if how < 0.4 else [rng.choice(vocabulary)] if how < 0.6 else [words[at] + "x"]
            rows.append((len(rows), " ".join(words)))
    return rows


def similar_pairs(rows):
    split = {d: t.split(" ") for d, t in rows}
    return [(a, b) for a, b in itertools.combinations(split, 2) if min(len(split[a]), len(split[b])) >= 5 and split[a] != split[b] and 5 * edits(split[a], split[b]) <= max(len(split[a]), len(split[b]))]


@pytest.mark.parametrize("least,most,blocks", [(5, 9, 9), (10, 24, 9), (25, 60, None)])
def test_all_pairs_of_similar_lines_meet(spark, least, most, blocks):
    """Every group of lines with up to a fifth of their words edited is what brute force finds: up to 24 words with nine blocks, beyond with all."""
    rows = edited_lines(random.Random(least), least, most, (0, 0.1, 0.2, 0.25))
    split = {d: t.split(" ") for d, t in rows}
    same = [(a, b) for a, b in itertools.combinations(split, 2) if split[a] == split[b] and len(split[a]) >= 5]
    top = roots_of(split, similar_pairs(rows) + same)
    out = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), most_blocks=blocks).collect()
    assert {r.doc_id for r in out if r.removed} == {d for d in split if top[d] != d}


def test_reordered_words_and_longest_deletions_against_brute_force(spark):
    """Lines of the same words in another order aren't similar; lines shorter by all the edits allowed are, wherever the scarce pairs lie. With nine blocks up to 24 words, beyond with all blocks."""
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(a, b)))
    rows = [(0, "w2 w11 w28 w101 w109 w164 alpha beta"), (1, "w11 w2 w101 w28 w164 w109 alpha beta"), (2, "xa xb xc xd xe xf abcdefgh xh ijklmnop xj"), (3, "xa xb extraordinary xd xe xf abcdefgh ijklmnop xj")]
    for n in (5, 8, 10, 12, 15, 16, 20, 24, 30, 45):
        for _ in range(12):
            line = [word(2, 9) for _ in range(n)]
            short, shuffled = list(line), list(line)
            gone = rng.sample(range(n), n // 5)
            if len(gone) > 1:  # one of the edits brings a pair that sorts before all others
                short[gone.pop()] = word(18, 20)
            for at in sorted(gone, reverse=True):
                del short[at]
            for at in range(0, n - 1, 2):
                shuffled[at], shuffled[at + 1] = shuffled[at + 1], shuffled[at]
            for x in (line, short, shuffled):
                rows.append((len(rows), " ".join(x)))
    for most, blocks in ((24, 9), (99, None)):
        some = [r for r in rows if len(r[1].split(" ")) <= most]
        top = roots_of([d for d, _ in some], similar_pairs(some))
        out = dedup_lines(spark.createDataFrame(some, "doc_id bigint, text string"), most_blocks=blocks).collect()
        assert {r.doc_id for r in out if r.removed} == {d for d, _ in some if top[d] != d}


def test_long_lines_meet_whatever_words_are_edited(spark, tmp_path):
    """All pairs that come first hold an edited word, so nine blocks miss the lines; the query and the stage of the pipeline have no such bound."""
    plain = [f"w{k:02d}" for k in range(40)]
    lines = [[f"long{side}word{k:02d}" if k % 5 == 2 else w for k, w in enumerate(plain)] for side in "ab"]
    rows = [(1, " ".join(lines[0])), (2, " ".join(lines[1]))]
    assert similar_pairs(rows) == [(1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert not any(r.removed for r in dedup_lines(docs, most_blocks=9).collect())
    assert {r.doc_id: r.removed for r in dedup_lines(docs).collect()} == {1: [], 2: [0]}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in op8_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("words", [8, 10, 15, 20, 30, 40, 80, 200])
def test_share_of_similar_pairs_found_with_nine_blocks(spark, words):
    """Pairs of a line and one with exactly as many words edited as similarity 0.8 allows: at least 0.97 are found (all of them up to 24 words)."""
    rng = random.Random(words)
    rows = []
    for i in range(150):
        line = [f"{''.join(rng.choice('abcdefghijklmnop') for _ in range(rng.randint(3, 9)))}" for _ in range(words)]
        other = list(line)
        for at in rng.sample(range(words), words // 5):
            other[at] = "".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(3, 9)))
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    gone = {r.doc_id for r in out if r.removed}
    assert all(d % 2 for d in gone)
    assert len(gone) == 150 if words <= 24 else len(gone) >= 0.97 * 150


def test_line_groups_with_a_common_pair_and_unlike_families(spark):
    """Lines that all share one long pair of words, in families of near copies: families stay apart."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(6):
        base = [rng.choice(vocabulary) for _ in range(20)]
        for k in range(30):
            line = list(base)
            for at in rng.sample(range(20), 2 if k else 0):
                line[at] = rng.choice(vocabulary)
            rows.append((f * 100 + k, " ".join([*line, "extraordinarily", "uncharacteristic"])))
    out = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    top = roots_of([d for d, _ in rows], similar_pairs(rows))
    assert {r.doc_id for r in out if not r.removed} == {d for d, _ in rows if top[d] == d}


def test_words_with_marks_and_of_writing_without_blanks(spark):
    hindi, thai = "यह हिन्दी की एक लम्बी पंक्ति है जो दो बार आती है", "นี่คือประโยคภาษาไทยที่ยาวพอสมควรสำหรับการทดสอบ"
    chinese = "这是一个没有空格的中文句子用来测试行去重功能是否正常"
    rows = [(1, hindi), (2, hindi.replace("लम्बी", "छोटी")), (3, hindi.replace("हिन्दी", "हिन्दु")), (4, thai), (5, thai), (6, chinese), (7, chinese.replace("中", "英")), (8, "一二三四五六七八九十" * 3)]
    out = {r.doc_id: r.removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: [], 2: [0], 3: [0], 4: [], 5: [0], 6: [], 7: [0], 8: []}


def test_exact_repeats_of_short_lines_go_in_the_query(spark, tmp_path):
    a, b, c = "Chapter one", "これは同じ文です。", "alpha beta gamma delta"
    rows = [(1, f"{a}\n\n{b}\n---\n{c}"), (2, f"chapter ONE.\n\n---\n{b}\nalpha beta gamma other"), (3, f"{b}\n{b}\n{c}!")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed for r in op8_line_dedup(spark, str(tmp_path)).collect()} == {1: [], 2: [0, 3], 3: [0, 1, 2]}


def test_unlike_lines_do_not_fill_blocks_or_pairs(spark, monkeypatch):
    """Lines that share a pair of words are in no block together, and lines of few words, each many times, become no pair for one of them."""
    from quillstone.llm import line_dedup

    rows_of, plain = {}, line_dedup.staged

    def counted(df, name, *more):
        out = plain(df, name, *more)
        rows_of[name] = rows_of.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    shared = [f"{' '.join(f'a{k}x{i}' for i in range(k % 9))} extraordinarily uncharacteristic {' '.join(f'b{k}x{i}' for i in range(12 - k % 9))}" for k in range(40)]
    assert not any(r.removed for r in dedup_lines(spark.createDataFrame(list(enumerate(shared)), "doc_id bigint, text string")).collect())
    assert rows_of["line-turn-0"] == 0
    rows_of.clear()
    filled = [" ".join(w for w in ("uncharacteristic", *(f"word{k}x{i}" for i in range(7))) for _ in range(15)) for k in range(40)]
    assert not any(r.removed for r in dedup_lines(spark.createDataFrame(list(enumerate(filled)), "doc_id bigint, text string")).collect())
    assert rows_of["line-turn-0"] > 0 and rows_of["line-near-0"] == 0 and not any(n for name, n in rows_of.items() if name.startswith("line-late"))


def test_lines_that_share_no_run_of_three_words_meet(spark):
    """Of five words an edit in the middle breaks all runs of three; of six, words added or changed leave one."""
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta other delta epsilon"), (3, "one two three four five"), (4, "one two three more four five"), (5, "red green blue white black grey"), (6, "red green blue pink black grey")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in out if r.removed} == {2, 4, 6}


def test_line_dedup_of_empty_and_huge(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long_line = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long_line), (2, long_line), (None, long_line)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.removed)) for r in out) == [(0, 0), (1, 1), (2, 1)]


def test_line_dedup_uses_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow", plan)
    assert dedup_lines(docs).where(F.col("text").isNull() != F.col("text").isNull()).count() == 0


def test_line_dedup_leaves_no_files_but_its_result(spark, tmp_path, monkeypatch):
    """Tables that nothing reads any more and the shuffle files of their writes would fill the disk."""
    from quillstone.llm import common
    from quillstone.llm.line_dedup import line_drops

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    rows = [(i, f"the lamp of house {i % 3} is lit at nightfall by the keeper {i}") for i in range(12)]
    drops = line_drops(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert drops.count() > 0
    assert [p.name[:11] for p in (tmp_path / "shared/quillstone").iterdir()] == ["line-drops-"]
    assert spark.conf.get(common.CLEANUP, "false") == "false"
