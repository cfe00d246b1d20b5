"""Mailbox tables in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.schema import CONTENTS, MESSAGES


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """All messages; a folder's candidates are found by filters on this scan."""
    return spark.read.schema(schema).parquet(path)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENTS).parquet(path)


def write_messages(messages: DataFrame, path: str, mode: str = "error") -> None:
    """Write metadata ordered by account, folder and date.

    The range split includes the UID, so one huge folder is shared by many
    tasks, and row-group statistics let later scans skip other folders and
    dates.  No directories per account: with many accounts they would only make
    small files.
    """
    order = ["account", "folder", "internal_date", "uid"]
    messages.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def porcelain_count(counts: DataFrame) -> DataFrame:
    """Machine-readable lines ``n folder``."""
    return counts.select(F.format_string("%d %s", F.col("n"), F.col("folder")).alias("line"))


def human_count(counts: DataFrame, filter_text: str) -> DataFrame:
    """Readable lines with the filter the counts were taken with."""
    from lettermill.functions.text import plural

    amount: Column = plural(F.col("n"), "%d message", "%d messages")
    return counts.select(
        F.concat(
            F.lit("folder `"), "folder", F.lit("` has "), amount, F.lit(" matching "),
            F.lit(filter_text),
        ).alias("line")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
