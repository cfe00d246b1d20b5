"""Time cut-offs kept in files: a stamp on the first line, or the file's age."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.values import seconds_to_ns


def timestamp_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, cutoff_ns) for files whose first line is decimal seconds."""
    files = spark.read.format("binaryFile").load([os.path.expanduser(p) for p in paths])
    text = F.decode(F.col("content"), "UTF-8")
    first_line = F.regexp_replace(F.split(text, "\n", 2)[0], r"^\s+|\s+$", "")
    complaint = F.concat(
        F.lit("failed to decode a timestamp from the first line of "), F.col("path")
    )
    return files.select(
        "path",
        F.coalesce(
            seconds_to_ns(first_line), F.raise_error(complaint).cast("bigint")
        ).alias("cutoff_ns"),
    )


def cutoff_from_timestamp_file(spark: SparkSession, path: str) -> int:
    """Nanoseconds since the epoch; fails, naming the path, when unreadable."""
    found = timestamp_files(spark, [path]).first()
    if found is None:  # Spark reads no row from an empty file
        raise ValueError(f"failed to decode a timestamp from the first line of {path}")
    return found["cutoff_ns"]


def cutoff_from_mtime(spark: SparkSession, path: str) -> int:
    """Modification time of a file as nanoseconds since the epoch.

    Asked of the file system: the file is often an empty one that was touched,
    and such files give no rows in any Spark source.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(file).getModificationTime() * 10**6
