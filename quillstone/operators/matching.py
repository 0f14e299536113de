"""Names to identities: employers to issuers, legislators to politicians, tickers to issuers, committees to classes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.scalars import committee_class, employer_name, is_no_employer
from quillstone.functions.similarity import Names, least_jaro, near_pairs

#: Names shorter than this match exactly or not at all; similarity a fuzzy match needs.
LEAST_LETTERS, THRESHOLD = 5, 0.85
#: Names of a block, and code points of all of them.
BLOCK, BLOCK_UNITS = 4096, 1 << 20


def _classes(df: DataFrame) -> dict[int, int]:
    """Names of each class of lengths, whose longest is less than twice the shortest: a few rows."""
    return {r.k: r.n for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}


def _numbered(classes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The first block of each class and their number; blocks of long names hold fewer of them."""
    out, at = {}, 0
    for k in sorted(classes):
        n = -(-classes[k] // max(1, min(BLOCK, BLOCK_UNITS >> (k + 1))))
        out[k], at = (at, n), at + n
    return out


def near_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, score) of distinct names, `a` of left and `b` of right, whose Jaro-Winkler similarity reaches the threshold; null and empty names are near none.

    Names are dealt to blocks by classes of their length, and blocks meet where lengths allow for the threshold
    at all. Within two blocks the letters that names have in common are counted in bit marks, array against
    array, and only pairs within the bound of the threshold are formed and scored. So each name of one side is
    held against marks of the other side's names, none is dropped, and a task holds two blocks of bounded size.
    """
    side = lambda df, c: df.select(F.col(c)).where(F.length(c) > 0).distinct().withColumn("k", F.floor(F.log2(F.length(c).cast("double")) + 1e-9).cast("int"))
    one, two = side(left, "a"), side(right, "b")
    of_one, of_two = _numbered(_classes(one)), _numbered(_classes(two))
    # The shorter name's letters are at most all in common.
    ratio = max(0.0, 3 * least_jaro(threshold, 4) - 2)
    meets = lambda k, j: min(2 ** (k + 1) - 1, 2 ** (j + 1) - 1) >= ratio * max(2**k, 2**j) - 1e-9

    def dealt(df: DataFrame, name: str, own: dict, other: dict, mine: str, others: str) -> DataFrame:
        spans = {k: [other[j] for j in other if meets(k, j)] for k in own}
        spans = {k: (min(at for at, _ in s), max(at + n for at, n in s) - 1) for k, s in spans.items() if s}
        if not spans:
            return df.where("false").select(F.lit(0).alias(mine), F.lit(0).alias(others), name)
        of = lambda f: F.element_at(F.create_map(*[F.lit(x) for k in spans for x in (k, f(k))]), F.col("k"))
        block = of(lambda k: own[k][0]) + F.pmod(F.xxhash64(name), of(lambda k: own[k][1])).cast("int")
        met = df.where(F.col("k").isin(list(spans)))
        return met.select(block.alias(mine), F.explode(F.sequence(of(lambda k: spans[k][0]), of(lambda k: spans[k][1]))).alias(others), name)

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = a.column("a").to_pylist(), b.column("b").to_pylist()
        i, j, score, _ = near_pairs(Names.of(x), Names.of(y), threshold)
        return pa.table({"a": pa.array([x[k] for k in i], pa.string()), "b": pa.array([y[k] for k in j], pa.string()), "score": pa.array(score)})

    key = ["block", "other"]
    rows, columns = dealt(one, "a", of_one, of_two, "block", "other"), dealt(two, "b", of_two, of_one, "other", "block")
    return rows.groupBy(*key).cogroup(columns.groupBy(*key)).applyInArrow(compared, "a string, b string, score double")


def match_employers(employers: DataFrame, issuers: DataFrame, threshold: float = THRESHOLD, column: str = "contributor_employer") -> DataFrame:
    """(employer, normalized, issuer_id, ticker, confidence, match_type) of the best issuer for each distinct employer.

    Names that are no employer go first, then equal names match, and only what is left is compared, each
    distinct name once with each issuer's distinct name that may be near enough.
    """
    raw = employers.where(F.col(column).isNotNull() & ~is_no_employer(column)).select(F.col(column).alias("employer")).distinct().withColumn("normalized", employer_name("employer")).where("normalized != ''")
    names = issuers.where("issuer_name is not null and issuer_name != ''").select("issuer_id", "ticker", employer_name("issuer_name").alias("issuer"))
    distinct = raw.select("normalized").distinct()
    exact = distinct.join(names, F.col("normalized") == F.col("issuer")).groupBy("normalized").agg(F.min(F.struct("issuer_id", "ticker")).alias("m")).select("normalized", "m.*", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type"))
    rest = distinct.join(exact, "normalized", "left_anti").where(F.octet_length("normalized") >= LEAST_LETTERS)
    scored = near_names(rest.select(F.col("normalized").alias("a")), names.select(F.col("issuer").alias("b")), threshold)
    # Of issuers that share a name, the one of the smallest id.
    first = names.groupBy("issuer").agg(F.min(F.struct("issuer_id", "ticker")).alias("m")).select(F.col("issuer").alias("b"), "m.*")
    fuzzy = scored.join(first, "b").groupBy(F.col("a").alias("normalized")).agg(F.max_by(F.struct("issuer_id", "ticker", "score"), F.struct("score", -F.col("issuer_id"))).alias("m")).select("normalized", "m.issuer_id", "m.ticker", F.col("m.score").alias("confidence"), F.lit("fuzzy").alias("match_type"))
    return raw.join(exact.unionByName(fuzzy), "normalized").select("employer", "normalized", "issuer_id", "ticker", "confidence", "match_type")


def match_legislators(legislators: DataFrame, politicians: DataFrame) -> DataFrame:
    """(politician_id, bioguide_id, fec_candidate_id): by last name and state of the last term; a key that several politicians share matches none."""
    keys = politicians.groupBy(F.lower("last_name").alias("last"), F.upper("state").alias("st")).agg(F.count("*").alias("n"), F.min("politician_id").alias("politician_id")).where("n = 1")
    people = legislators.select(F.lower("name.last").alias("last"), F.upper(F.element_at("terms", -1)["state"]).alias("st"), F.col("id.bioguide").alias("bioguide_id"), F.explode("id.fec").alias("fec_candidate_id"))
    return people.join(keys, ["last", "st"]).select("politician_id", "bioguide_id", "fec_candidate_id")


def committees_of(mappings: DataFrame) -> DataFrame:
    """All committee ids over a politician's candidate ids, as a set."""
    return mappings.select("politician_id", F.explode("committee_ids").alias("c")).groupBy("politician_id").agg(F.array_sort(F.collect_set("c")).alias("committee_ids"))


def mapped_politicians(politicians: DataFrame, mappings: DataFrame) -> DataFrame:
    """Politicians with any candidate id, each once however many it has."""
    return politicians.join(mappings.select("politician_id"), "politician_id", "left_semi")


def resolve_tickers(wanted: DataFrame, issuers: DataFrame) -> DataFrame:
    """The issuer's ticker for each wanted one: equal, else the smallest that begins with it and a colon. wanted: (ticker)."""
    listed = issuers.where("ticker is not null").select(F.col("ticker").alias("found"), F.substring_index("ticker", ":", 1).alias("stem"))
    exact = wanted.join(listed.select("found").distinct(), F.col("ticker") == F.col("found"), "left")
    stems = listed.where(F.contains("found", F.lit(":"))).groupBy("stem").agg(F.min("found").alias("by_stem"))
    return exact.join(stems, F.col("ticker") == F.col("stem"), "left").select("ticker", F.coalesce("found", "by_stem").alias("issuer_ticker"))


def resolve_committees(wanted: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """Committee ids from the first tier that knows the politician. tiers: (politician_id, committee_ids)."""
    out = wanted.select("politician_id").distinct()
    for i, tier in enumerate(tiers):
        out = out.join(tier.select("politician_id", F.col("committee_ids").alias(f"_t{i}")), "politician_id", "left")
    return out.select("politician_id", F.coalesce(*[f"_t{i}" for i in range(len(tiers))]).alias("committee_ids"))


def classified(committees: DataFrame) -> DataFrame:
    return committees.withColumn("class", committee_class("committee_type", "designation"))
