"""Archive in Parquet: a narrow index and the content it names.

Content is written where it was read, without moving it between tasks.  Only
the index (hash, duplicate number, name, origin) goes through shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.schema import ARCHIVE, MESSAGE_KEY

_CONTENT = (
    "account STRING, folder STRING, uid BIGINT, msg_hash STRING, length BIGINT, "
    "header BINARY, body BINARY, cycle_id BIGINT"
)


def write_archive_content(clean: DataFrame, path: str, cycle_id: int, part: str = "0") -> DataFrame:
    """Write clean content with its hash and length; returns what was written.

    Writing the same cycle and part again replaces it.
    """
    target = f"{path}/content/cycle_id={cycle_id}/part={part}"
    clean.select(
        *MESSAGE_KEY, "msg_hash", "length",
        F.col("header").cast("binary").alias("header"), F.col("body").cast("binary").alias("body"),
    ).write.mode("overwrite").option("compression", "zstd").parquet(target)
    stored = clean.sparkSession.read.parquet(target)
    return stored.select(*MESSAGE_KEY, "msg_hash", "length")


def write_archive_index(
    named: DataFrame, path: str, cycle_id: int, part: str = "0"
) -> None:
    """Write index rows, in one directory per first hex digit of the hash.

    Spark sizes the files itself: a digit with very many rows (copies of one
    content all share theirs) is divided, small ones are put together.
    """
    prefixed = named.select(
        "msg_hash", "dup_no", "length", "name", *MESSAGE_KEY,
        F.substring("msg_hash", 1, 1).alias("hash_prefix"),
    )
    prefixed.hint("rebalance", "hash_prefix").write.mode("overwrite").partitionBy(
        "hash_prefix"
    ).parquet(f"{path}/index/cycle_id={cycle_id}/part={part}")


def write_archive_table(
    rows: DataFrame, path: str, cycle_id: int = 0, part: str = "0"
) -> None:
    """Write named messages: hash, duplicate number, length, name, raw content."""
    write_archive_content(rows, path, cycle_id, part)
    write_archive_index(rows, path, cycle_id, part)


def read_archive_index(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{ARCHIVE}, part STRING, hash_prefix STRING"
    return spark.read.schema(schema).option("basePath", f"{path}/index").parquet(f"{path}/index")


def read_archive_content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_CONTENT}, part STRING").parquet(f"{path}/content")


def read_archive_table(spark: SparkSession, path: str, **facts: Column) -> DataFrame:
    """Index rows together with their content, or with ``facts`` about it (columns by name).

    Facts are taken where the content lies; then only they, not the content, go to the index.
    """
    keys = [*MESSAGE_KEY, "cycle_id", "part"]
    taken = [column.alias(name) for name, column in facts.items()] or ["header", "body"]
    content = read_archive_content(spark, path).select(*keys, *taken)
    return read_archive_index(spark, path).join(content, keys).drop("part")
