"""Row numbers within groups of any size.

A window over a whole group runs in one task, and one folder or one piece of
content may own a third of all rows.  Here a group is divided into blocks by
its own order keys, rows are numbered inside their block, and blocks are
counted up from fine to coarse, so every window sees a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.schema import FETCH_NUMBER
from lettermill.session import materialise

# UIDs are unique in a folder, so a block of this many consecutive UIDs holds
# at most this many rows.
UID_BLOCK = 1 << 16
ACCOUNT_BLOCK = 1 << 10


def _before(counts: DataFrame, keys: list[str], level: int, levels: list[list[str]],
            base: DataFrame | None) -> DataFrame:
    """Rows that precede each block: in its parent block, and before the parent."""
    parent = [c for part in levels[: level] for c in part]
    own = levels[level]
    w = (
        Window.partitionBy(*keys, *parent)
        .orderBy(*own)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    at = [*keys, *parent, *own]
    if level == 0:
        if base is not None:
            local = local.join(base, keys, "left").withColumn(
                "_before", F.col("_before") + F.coalesce("_base", F.lit(0))
            )
        return local.select(*at, "_before")
    coarser = counts.groupBy(*keys, *parent).agg(F.sum("_n").alias("_n"))
    above = _before(coarser, keys, level - 1, levels, base).withColumnRenamed("_before", "_above")
    return local.join(above, [*keys, *parent]).select(
        *at, (F.col("_before") + F.col("_above")).alias("_before")
    )


def number_rows(
    rows: DataFrame,
    keys: list[str],
    levels: list[list[str]],
    order: list[str],
    out: str,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: the position (from 0) of each row in its ``keys`` group.

    ``levels`` lists block columns from coarse to fine; read one after another
    they must agree with ``order``.  ``base`` (keys, ``_base``) shifts a group.
    """
    block = [*keys, *[c for level in levels for c in level]]
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = _before(counts, keys, len(levels) - 1, levels, base)
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(*order)) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(before, block)
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before")
    )


def number_in_folder(rows: DataFrame, out: str = "position") -> DataFrame:
    """Position of each message in its folder, in UID order."""
    blocked = rows.withColumn("_uid_block", F.expr(f"uid div {UID_BLOCK}"))
    return number_rows(
        blocked, ["account", "folder"], [["_uid_block"]], ["uid"], out
    ).drop("_uid_block")


def chunk(rows: DataFrame, n: int = FETCH_NUMBER) -> DataFrame:
    """Add ``chunk``: runs of ``n`` messages in UID order, the last one shorter."""
    return number_in_folder(rows, "_position").withColumn(
        "chunk", F.expr(f"_position div {n}")
    ).drop("_position")


def _spared(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows whose content is not crowded; those without a hash never are."""
    no_hash = F.col("msg_hash").isNull()
    short = F.when(no_hash, F.lit(None)).otherwise(F.col("_short"))
    return rows.withColumn("_short", short).join(crowded, "_short", "left_anti").drop("_short")


def duplicate_number(
    rows: DataFrame,
    archive: DataFrame | None = None,
    hot: int = UID_BLOCK,
    stored: bool = False,
) -> DataFrame:
    """Add ``dup_no``: 0 for the first copy of some content, 1 for the next, …

    Copies are ordered by account, folder and UID.  Numbers continue after those
    that ``archive`` (msg_hash, dup_no) already holds.

    Content with at most ``hot`` copies is numbered by one window per content.
    There can be no more than rows / ``hot`` contents with more copies than
    that; they are numbered by blocks.

    The rows are read several times, so unless they are ``stored`` already they
    are written out first: their hashes are costly to compute from content.
    """
    if not stored:
        rows = materialise(rows, "hashes")
    base = None
    if archive is not None:
        # Of a large archive only the contents at hand matter.
        known = archive.join(rows.select("msg_hash").distinct(), "msg_hash", "left_semi")
        base = known.groupBy("msg_hash").agg((F.max("dup_no") + 1).alias("_base"))
    # Counted by a short hash of the hash: contents that share one only come to the crowded side.
    rows = rows.withColumn("_short", F.xxhash64("msg_hash"))
    crowded = (
        rows.filter("msg_hash is not null")
        .groupBy("_short")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot)
        .select("_short")
    )
    order = ["account_idx", "folder_idx", "uid"]
    few = _spared(rows, crowded).withColumn(
        "dup_no",
        (F.row_number().over(Window.partitionBy("msg_hash").orderBy(*order)) - 1).cast("bigint"),
    )
    if base is not None:
        few = (
            few.join(base, "msg_hash", "left")
            .withColumn("dup_no", F.col("dup_no") + F.coalesce("_base", F.lit(0)))
            .drop("_base")
        )
    many = (
        rows.join(crowded, "_short", "left_semi")
        .drop("_short")
        .filter("msg_hash is not null")
        .withColumn("_account_block", F.expr(f"account_idx div {ACCOUNT_BLOCK}"))
        .withColumn("_uid_block", F.expr(f"uid div {UID_BLOCK}"))
    )
    many = number_rows(
        many,
        ["msg_hash"],
        [["_account_block"], ["account_idx", "folder_idx"], ["_uid_block"]],
        order,
        "dup_no",
        base,
    ).drop("_account_block", "_uid_block")
    return few.unionByName(many)
