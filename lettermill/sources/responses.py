"""Captured server responses, loaded from text lines into typed tables.

Each function takes a table with a ``line`` column and keeps its other columns
(such as the account and folder the line belongs to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.delivery import conflicts


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _context(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "line"]


def _number(name: str) -> Column:
    """The last value given for a name inside the parentheses, names in any case."""
    found = F.regexp_extract("line", rf"(?i)^.*[( ]{name} +([0-9]+)(?=[ )])", 1)
    return F.when(found != "", found.cast("bigint"))


def ingest_fetch_metadata(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid and size rows, conflict rows) from size responses."""
    parsed = lines.select(
        *_context(lines), "line", _number("UID").alias("uid"),
        _number(r"RFC822\.SIZE").alias("size"),
    )
    good, bad = conflicts(parsed, ["uid", "size"])
    return good.drop("line"), bad


def ingest_search_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per UID, error rows) from search responses.

    An empty result is no rows; a missing (null) one is an error of its folder.
    """
    uids = F.split(F.trim("line"), " +")
    good = (
        lines.filter(F.col("line").isNotNull())
        .select(*_context(lines), F.explode(uids).alias("_uid"))
        .filter("_uid <> ''")
        .select(*_context(lines), F.col("_uid").cast("bigint").alias("uid"))
    )
    bad = lines.filter(F.col("line").isNull()).select(
        *_context(lines),
        F.lit("error").alias("status"),
        F.lit("IMAP SEARCH command failed: no result").alias("detail"),
    )
    return good, bad


def _unquoted(text: Column) -> Column:
    inner = F.regexp_extract(text, r'^"(.*)"$', 1)
    return F.when(text.startswith('"'), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(text)


def ingest_list_response(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attributes, delimiter and folder; error rows) from folder list responses.

    A line that is no such response, or whose name follows as a literal (``{5}``), is an
    error: its folder would be missing from everything that comes after.
    """
    token = r'("(?:[^"\\]|\\.)*"|[^ "{][^ "]*)'
    shape = rf"^ *\(([^)]*)\) +{token} +{token} *$"
    fits = F.coalesce(F.col("line").rlike(shape), F.lit(False))
    attributes = F.trim(F.regexp_extract("line", shape, 1))
    good = lines.filter(fits).select(
        *_context(lines),
        F.filter(F.split(attributes, " +"), lambda a: a != "").alias("attributes"),
        _unquoted(F.regexp_extract("line", shape, 2)).alias("delimiter"),
        _unquoted(F.regexp_extract("line", shape, 3)).alias("folder"),
    )
    bad = lines.filter(~fits).select(
        *_context(lines), "line", F.lit("error").alias("status"),
        F.lit("this line of the folder list cannot be read").alias("detail"),
    )
    return good, bad
