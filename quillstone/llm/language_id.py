"""Language identification by a bidirectional gated recurrent network over bytes.

The network is fitted on a bounded, seeded sample: at most `per_language` labelled documents of each
language, of each at most `windows` stretches of `train_chars` characters, hashed places apart. It learns
only from text and non-null language of documents whose crc32(doc_id as text) mod 5 isn't 0. Prediction
reads whole texts: every byte of a document is labelled, in windows that see `halo` bytes beyond either end,
and the probabilities at all bytes of letters are averaged.

A null text, or one without a letter, is `und` with score 0; so is every row where nothing could be learned.
A null doc_id counts as the empty text, so it is held out. Repeated rows are predicted each. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.byte_gru import ByteGru
from quillstone.llm.common import bounded, column, fresh, table

FOLDS, HELD = 5, 0
PER_LANGUAGE, WINDOWS, TRAIN_CHARS, TRAIN_BYTES = 400, 3, 96, 64
#: Labels learned at most, so that a column full of junk labels doesn't make the sample grow.
MOST_LANGUAGES = 100
WINDOW, HALO, AT_ONCE, STEP = 224, 16, 2048, 32


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, windows: int, most_languages: int = MOST_LANGUAGES) -> pd.DataFrame:
    """(lang, piece): at most per_language * windows rows for each language, of the most_languages that have most texts; scarcer labels aren't learned."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(11), text_col).alias("seed"))
    frequent = rows.groupBy("lang").agg(F.countDistinct("seed").alias("c")).orderBy(F.desc("c"), "lang").limit(most_languages)
    counts = {r["lang"]: r["c"] for r in frequent.collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    # Equal texts count once. A share of each language by hash leaves about three times the bound; ranking then sees little.
    share = F.create_map(*[F.lit(v) for lang, c in sorted(counts.items()) for v in (lang, min(1.0, (3.0 * per_language + 50) / c))])
    some = rows.where(F.pmod("seed", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).dropDuplicates(["lang", "seed"])
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("seed"))).where(F.col("k") <= per_language)
    room = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1
    pieces = F.array(*[F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(k), "seed"), room) + 1).cast("int"), F.lit(TRAIN_CHARS)) for k in range(windows)])
    return first.select("lang", F.explode(pieces).alias("piece")).toPandas()


def fit(sample: pd.DataFrame, hidden: int = 12, steps: int = 220, seed: int = 5) -> tuple[ByteGru, list[str]] | None:
    languages = sorted(set(sample["lang"]))
    if not languages:
        return None
    sample = sample.sort_values(["lang", "piece"])
    x = np.zeros((len(sample), TRAIN_BYTES), np.uint8)
    for row, piece in zip(x, sample["piece"], strict=True):
        raw = np.frombuffer(piece.encode()[:TRAIN_BYTES], np.uint8)
        row[: len(raw)] = raw
    y = np.searchsorted(languages, sample["lang"].to_numpy(str))
    # Each language weighs the same: scarce ones are repeated.
    rng = np.random.Generator(np.random.PCG64(seed))
    most = max(np.bincount(y))
    rows = np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == k)), most) for k in range(len(languages))])
    net = ByteGru(len(languages), hidden, seed)
    net.train(x[rows], y[rows], steps)
    return net, languages


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def pooled(net: ByteGru, texts: list[bytes], window: int = WINDOW, halo: int = HALO, at_once: int = AT_ONCE) -> np.ndarray:
    """(texts, classes): mean probabilities over the letter bytes of each text (all bytes where there is none)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(net.p["b"])))
    weight = np.zeros(len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    each = -(-sizes // window)
    doc = np.repeat(np.arange(len(texts)), each)
    start = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * window
    # A window's width follows from its length alone, so no result depends on the texts beside it; short ones aren't run at full width.
    length = np.minimum(window, sizes[doc] - start)
    wide = np.minimum(window, -(-length // STEP) * STEP)
    order = np.argsort(-wide, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(wide[order])) + 1) if len(order) else []
    for ix in (run[a : a + at_once] for run in runs for a in range(0, len(run), at_once)):
        width = int(wide[ix[0]])
        at = start[ix][:, None] + np.arange(-halo, width + halo)[None, :]
        inside = (at >= 0) & (at < sizes[doc[ix]][:, None])
        x = np.where(inside, data[np.where(inside, begins[doc[ix]][:, None] + at, 0)], 0).astype(np.uint8)
        prob = net.probabilities(x)[:, halo : halo + width]
        core = x[:, halo : halo + width].T
        counted = (_LETTER[core] & (np.arange(width)[:, None] < length[ix][None, :])).astype(np.float32)
        np.add.at(total, doc[ix], np.einsum("ctn,tn->nc", prob, counted))
        np.add.at(weight, doc[ix], counted.sum(axis=0))
    return total / np.maximum(weight, 1)[:, None]


_PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(model: tuple[ByteGru, list[str]] | None):
    """A column function: text to (lang_pred, score)."""

    @F.pandas_udf(_PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            ix = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            at = 0
            while model is not None and at < len(ix):  # about 4 MB of text at once
                to, size = at, 0
                while to < len(ix) and (to == at or size < 4 << 20):
                    size += len(texts.iloc[ix[to]])
                    to += 1
                prob = pooled(model[0], [texts.iloc[i].encode() for i in ix[at:to]])
                best = prob.argmax(axis=1)
                lang[ix[at:to]] = np.array(model[1], object)[best]
                score[ix[at:to]] = np.clip(prob[np.arange(len(best)), best], 0, 1)
                at = to
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict.asNondeterministic()  # evaluated once, not again in each filter above it


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> DataFrame:
    """docs with one more column at the end, a struct of lang_pred and score: language, or with underscores where docs has such a column."""
    bounded(docs.sparkSession)
    model = fit(training_sample(docs, id_col, text_col, lang_col, per_language, windows))
    return docs.withColumn(fresh(docs, "language"), predictor(model)(column(text_col)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")
