"""Mixing sources to target weights through a tree of domains, languages and sources.

1. A leaf is a (domain, language, source). Its tokens, ids of a public vocabulary, are counted over all documents.
2. The token budget flows down the tree: each node's share is split among its children by weight, in whole
   numbers. A child that can't use its share takes all it has, and what is left goes to its siblings by weight
   before anything returns to the level above. Leaves may be read up to `most_epochs` times. A child of weight 0
   gets nothing, and what it has counts nowhere. The tree is a table: each level is one window over its parents.
3. Each epoch of a leaf puts the documents in an order of its own by a seeded hash. Whole epochs are taken
   whole; of the last one the prefix is taken whose tokens don't exceed what is left of the leaf's budget.
   The prefix is found without sorting a leaf in one task: tokens are summed for 512 ranges of the hash, the
   sums are accumulated in order, the range that holds the end is split into 512 again, and only documents
   of the last range are ordered among themselves.

A null language or source is a leaf of its own, written as "". Null texts and texts without tokens count 0
and belong to the prefix like any other. Rows that repeat a doc_id and text are one place in the order
and are taken together. Extra columns are carried along, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bounded, column, fresh, staged, table
from quillstone.llm.token_counts import n_tokens

#: Bits of a range of the order, twice; leaves that may be broadcast.
SLOT_BITS, BROADCAST_LEAVES = 9, 10_000
#: A weight has six decimals.
UNIT = 10**6
LEVELS = ["domain", "lang", "source"]


def split(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """children (*parent, own, weight, most, amount) with `given`: each parent's amount split by weight; what exceeds a child's most goes to the others by weight.

    Whole numbers; the largest remainders get the rest. amount mustn't exceed what children of positive weight can take.
    """
    kept = parent or [F.lit(1)]
    live = children.where("weight > 0 and most > 0").withColumn("weight", F.col("weight").cast("decimal(12,0)")).withColumn("most", F.col("most").cast("decimal(20,0)"))
    # By what they can take for each unit of weight, the first so many are full: one is if it is so even when all after it share with it.
    order = Window.partitionBy(*kept).orderBy(F.col("most") / F.col("weight"), own)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    big = lambda c: c.cast("decimal(20,0)")
    full = big(F.col("amount") - before) * F.col("weight") >= F.col("most") * big(after)
    every = Window.partitionBy(*kept)
    part = live.withColumn("full", full).withColumn("left", big(F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0)))).withColumn("all", big(F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)))
    part = part.withColumn("base", F.when(~F.col("full"), F.expr("cast(left * weight div all as decimal(20,0))"))).withColumn("over", F.when(~F.col("full"), F.expr("left * weight % all")))
    first = Window.partitionBy(*kept).orderBy(F.col("over").desc_nulls_last(), own)
    spare = F.col("left") - F.sum("base").over(every)
    given = F.when(F.col("full"), F.col("most")).otherwise(F.col("base") + (F.row_number().over(first) <= spare).cast("int"))
    return part.select(*parent, own, given.cast("bigint").alias("given"))


def budgets(leaves: DataFrame, weights: dict[tuple, float], total: int, most_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf. leaves: (domain, lang, source, tokens); weights: of nodes by path, 1.0 where none is given."""
    spark = leaves.sparkSession
    node = leaves
    for d in range(len(LEVELS)):
        rows = [(*path, round(Fraction(str(w)) * UNIT)) for path, w in weights.items() if len(path) == d + 1]
        given = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in LEVELS[: d + 1]) + f", w{d} bigint")
        node = node.join(given, LEVELS[: d + 1], "left").withColumn(f"w{d}", F.coalesce(f"w{d}", F.lit(UNIT)))
    node = staged(node.withColumn("most", F.when(F.col("w2") > 0, F.col("tokens").cast("decimal(20,0)") * most_epochs).otherwise(0)), "mix-leaves")
    langs = node.groupBy("domain", "lang", "w0", "w1").agg(F.sum("most").alias("m")).withColumn("most", F.when(F.col("w1") > 0, F.col("m")).otherwise(0))
    domains = langs.groupBy("domain", "w0").agg(F.sum("most").alias("m")).withColumn("most", F.when(F.col("w0") > 0, F.col("m")).otherwise(0))
    amount = F.least(F.lit(total).cast("decimal(20,0)"), F.sum("most").over(Window.partitionBy(F.lit(1))))
    given = split(domains.select("domain", F.col("w0").alias("weight"), "most", amount.alias("amount")), [], "domain")
    given = split(langs.select("domain", "lang", F.col("w1").alias("weight"), "most").join(given.withColumnRenamed("given", "amount"), "domain"), ["domain"], "lang")
    given = split(node.select(*LEVELS, F.col("w2").alias("weight"), "most").join(given.withColumnRenamed("given", "amount"), ["domain", "lang"]), ["domain", "lang"], "source")
    return node.select(*LEVELS, "tokens").join(given, LEVELS, "left").select(*LEVELS, "tokens", F.coalesce("given", F.lit(0)).alias("budget"))


def _end(rows: DataFrame, slot: str) -> DataFrame:
    """(leaf, slot, base): the range in which the sum of tokens, on top of base so far, first exceeds rest."""
    sums = rows.groupBy(*LEVELS, "rest", "base", slot).agg(F.sum("tokens").alias("t"))
    after = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy(slot)) + F.col("base")
    found = sums.withColumn("after", after).where(F.col("after") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct(slot, (F.col("after") - F.col("t")).alias("base"))).alias("end"))
    return found.select(*LEVELS, F.col(f"end.{slot}").alias(f"{slot}_end"), F.col("end.base").alias("base"))


def mixed(docs: DataFrame, domain: Callable[[], Column], weights: dict[tuple, float], share: float, most_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", vocabulary: str | None = None) -> DataFrame:
    """docs that are read at least once, with four more columns at the end: domain, tokens, copies (times read) and leaf_budget.

    share: of all tokens there; domain: makes the column that names a row's domain. Where docs has a column of
    such a name, the new one's name gets an underscore.
    """
    bounded(docs.sparkSession)
    text_of = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    doc = F.struct(*[column(c) for c in docs.columns]).alias("doc")
    rows = staged(docs.select(doc, domain().alias("domain"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), n_tokens(column(text_col), vocabulary).alias("tokens"), F.xxhash64(column(id_col), column(text_col)).alias("u")), "mix-rows")
    light = rows.drop("doc")
    leaves = staged(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-sums")
    there = leaves.agg(F.sum("tokens").cast("bigint"), F.count("*")).first()
    given = budgets(leaves, weights, int((there[0] or 0) * Fraction(str(share))), most_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("int")
    rest = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)
    tree = staged(given.select(*LEVELS, F.col("budget").alias("leaf_budget"), whole.alias("whole"), rest.alias("rest")), "mix-tree")
    small = F.broadcast if there[1] <= BROADCAST_LEAVES else lambda df: df

    def placed(df: DataFrame) -> DataFrame:
        """Adds the place in the leaf's last epoch, the one after its whole ones, and two ranges of it, one within the other."""
        df = df.join(small(tree), LEVELS).withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("whole"), F.col("u")), 1))
        return df.withColumn("coarse", F.shiftright("key", 63 - SLOT_BITS)).withColumn("fine", F.shiftright("key", 63 - 2 * SLOT_BITS))

    at = placed(light).where("rest > 0")
    coarse = staged(_end(at.withColumn("base", F.lit(0).cast("bigint")), "coarse"), "mix-coarse")
    inside = at.join(small(coarse), LEVELS).where(F.col("coarse") == F.col("coarse_end"))
    fine = staged(_end(inside, "fine"), "mix-fine")
    edge = at.join(small(fine), LEVELS).where(F.col("fine") == F.col("fine_end"))
    order = edge.groupBy(*LEVELS, "key", "base", "rest").agg(F.sum("tokens").alias("t"))
    order = order.withColumn("sum", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("key")) + F.col("base"))
    last = order.where(F.col("sum") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("to"))
    ends = staged(fine.select(*LEVELS, "fine_end").join(last, LEVELS, "left"), "mix-ends")
    cut = placed(rows).join(small(ends), LEVELS, "left")
    prefix = (F.col("rest") > 0) & ((F.col("fine") < F.col("fine_end")) | ((F.col("fine") == F.col("fine_end")) & (F.col("key") <= F.coalesce("to", F.lit(-1)))))
    out = cut.withColumn("copies", F.col("whole") + F.coalesce(prefix, F.lit(False)).cast("int")).where("copies > 0")
    return out.select(*[column("doc", c).alias(c) for c in docs.columns], *[F.col(c).alias(fresh(docs, c)) for c in ("domain", "tokens", "copies", "leaf_budget")])


#: The mixture of the query: sources by domain (any other source is of the domain "other"), and English preferred within each.
SOURCES = {"books": ("src0", "src1", "src2", "src3"), "code": ("src4", "src5", "src6"), "forums": ("src7", "src8", "src9", "src10"), "web": tuple(f"src{i}" for i in range(11, 20))}
WEIGHTS = {("books",): 2.0, ("code",): 1.0, ("web",): 3.0, ("forums",): 1.0, ("other",): 1.0, **{(d, lang): w for d in (*SOURCES, "other") for lang, w in (("en", 3.0), ("fr", 1.0), ("de", 1.0), ("es", 1.0))}}
SHARE, EPOCHS, SEED = 0.7, 2, 17


def domain_of_source(source_col: str = "source") -> Column:
    out = F.lit("other")
    for name, sources in SOURCES.items():
        out = F.when(column(source_col).isin(*sources), name).otherwise(out)
    return out


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixed(table(spark, sf_dir, "documents"), domain_of_source, WEIGHTS, SHARE, EPOCHS, SEED)
    return chosen.select("doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), F.col("copies").cast("bigint").alias("copies"), "leaf_budget")
