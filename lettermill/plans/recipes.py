"""Documented ways to put the commands together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.filters import MessageFilter
from lettermill.operators.folders import FolderChoice
from lettermill.plans.commands import Command, Delete, Fetch, Target


def backup_then_expire(
    target: Target,
    stamps: Sequence[str],
    keep_days: int = 7,
    folders: FolderChoice = FolderChoice(),
) -> list[Command]:
    """Fetch new mail; delete seen mail older than the last backup and ``keep_days``."""
    expire = MessageFilter(older_than_days=(keep_days,), older_than_timestamp_in=tuple(stamps))
    return [Fetch(target=target, folders=folders), Delete(filter=expire, folders=folders)]


def staged_backfill(
    target: Target,
    years: Sequence[int] = (10, 5, 3, 2, 1),
    folders: FolderChoice = FolderChoice(),
) -> list[Command]:
    """Fetch a long history oldest first; each tranche takes what is still unseen."""
    return [
        Fetch(
            target=target, folders=folders,
            filter=MessageFilter(seen=False, older_than_days=(365 * y,)),
        )
        for y in years
    ]


def tranche(messages: DataFrame, now: dt.datetime, days: Sequence[int]) -> DataFrame:
    """Add ``tranche``: which stage of a backfill takes a message (null: none yet).

    One pass instead of one selection per stage; ``days`` fall.
    """
    number: Column = F.lit(None).cast("int")
    for i in reversed(range(len(days))):
        old = MessageFilter(older_than_days=(days[i],)).column(now)
        number = F.when(old, F.lit(i)).otherwise(number)
    return messages.withColumn("tranche", number)


def two_trackers_expire(
    keep_days: int, folders: FolderChoice = FolderChoice()
) -> Delete:
    """Delete only what both consumers, one per flag, have taken."""
    both = MessageFilter(seen=True, flagged=True, older_than_days=(keep_days,))
    return Delete(filter=both, folders=folders)


def reconcile_archives(a: DataFrame, b: DataFrame) -> DataFrame:
    """(msg_hash, copies_a, copies_b, side) of two archives compared by content.

    Copies are counted per archive first, so the join meets every content once
    on each side, however often it was stored.
    """
    left = a.groupBy("msg_hash").agg(F.count(F.lit(1)).alias("copies_a"))
    right = b.groupBy("msg_hash").agg(F.count(F.lit(1)).alias("copies_b"))
    return (
        left.join(right, "msg_hash", "full_outer")
        .select(
            "msg_hash",
            F.coalesce("copies_a", F.lit(0)).alias("copies_a"),
            F.coalesce("copies_b", F.lit(0)).alias("copies_b"),
        )
        .withColumn(
            "side",
            F.when(F.col("copies_b") == 0, "only_a")
            .when(F.col("copies_a") == 0, "only_b")
            .otherwise("both"),
        )
    )


def oldest_copies(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per content: the first in ``order``.

    A minimum, not a numbering: it is taken partly before the shuffle, so a
    content with very many copies stays cheap.
    """
    rest = [c for c in rows.columns if c != "msg_hash" and c not in order]
    return (
        rows.groupBy("msg_hash")
        .agg(F.min(F.struct(*order, *rest)).alias("_kept"))
        .select("msg_hash", "_kept.*")
    )
