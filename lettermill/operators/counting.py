"""Message counts per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.schema import FOLDER_KEY


def count_by_folder(messages: DataFrame, folders: DataFrame, condition: Column) -> DataFrame:
    """One row per visited folder with its number of matches, zeros included.

    The count is reduced to one row per folder before the join, so the join
    sees folders only, however many messages a folder holds.
    """
    counts = messages.filter(condition).groupBy(*FOLDER_KEY).agg(F.count(F.lit(1)).alias("n"))
    return folders.join(counts, FOLDER_KEY, "left").select(
        "account_idx", "account", "folder_idx", "folder", F.coalesce("n", F.lit(0)).alias("n")
    )


def count_many(
    messages: DataFrame, folders: DataFrame, conditions: dict[str, Column]
) -> DataFrame:
    """Several counts per folder out of one scan of the messages.

    Rows come as account × command × folder, zeros included.
    """
    names = list(conditions)
    counted = messages.groupBy(*FOLDER_KEY).agg(
        *[F.count_if(conditions[name]).alias(f"_c{i}") for i, name in enumerate(names)]
    )
    per_command = F.array(
        *[
            F.struct(
                F.lit(i).alias("command_idx"),
                F.lit(name).alias("name"),
                F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("bigint").alias("n"),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        folders.join(counted, FOLDER_KEY, "left")
        .select("account_idx", "account", "folder_idx", "folder", F.inline(per_command))
        .select("account_idx", "account", "command_idx", "name", "folder_idx", "folder", "n")
    )
