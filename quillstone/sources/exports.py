"""Results as Markdown, CSV and XML: rows become text in Spark and are written by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.scalars import employer_name, is_no_employer
from quillstone.operators.matching import match_employers

#: What an element of an array is called, by the array's name; fixed values.
SINGULAR = {"committees": "committee", "labels": "label", "eodPrices": "priceSet", "priceSet": "value"}


def csv_cell(value: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets a tab before it."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("\t"), value)).otherwise(value)


def safe_csv(df: DataFrame) -> DataFrame:
    """All text columns as csv_cell gives them."""
    return df.select(*[csv_cell(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line) of a Markdown table's rows; bars are escaped, line ends become blanks, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def xml_element(tag: str, value: Column, kind: T.DataType) -> Column:
    """A value as an element: nulls are left out, an array's items get the singular of its name, a struct's fields their own."""
    if isinstance(kind, T.ArrayType):
        inside = F.array_join(F.transform(value, lambda x: F.coalesce(xml_element(SINGULAR.get(tag, tag), x, kind.elementType), F.lit(""))), "")
    elif isinstance(kind, T.StructType):
        inside = F.concat(F.lit(""), *[F.coalesce(xml_element(f.name, value[f.name], f.dataType), F.lit("")) for f in kind])
    else:
        inside = _escaped(value.cast("string"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{tag}>"), inside, F.lit(f"</{tag}>")))


def xml_rows(df: DataFrame, tag: str) -> DataFrame:
    """(line): each row as one element; write it between the root's tags."""
    return df.select(xml_element(tag, F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).alias("line"))


def employers_for_review(unmatched: DataFrame, issuers: DataFrame, threshold: float) -> DataFrame:
    """Unmatched employers with a suggestion, to be confirmed by hand: the file that confirmed_employers reads. unmatched: (contributor_employer)."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    found = match_employers(unmatched, issuers, threshold).join(issuers.select("issuer_id", "issuer_name"), "issuer_id")
    rows = unmatched.where(~is_no_employer("contributor_employer")).select(F.col("contributor_employer").alias("employer"), employer_name("contributor_employer").alias("normalized"))
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    out = rows.join(found.drop("normalized"), "employer", "left")
    return out.select(csv_cell(F.col("employer")).alias("employer"), "normalized", text(F.col("ticker"), "suggestion_ticker"), text(F.col("issuer_name"), "suggestion_name"), F.lit("").alias("suggestion_sector"), text(F.format_number("confidence", 2), "confidence"), F.lit("").alias("confirmed_ticker"), F.lit("").alias("notes"))
