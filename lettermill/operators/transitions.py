"""State changes: pure functions from a message table to a message table.

They look at metadata only; content lives in its own table and is never
rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.filters import MARKS
from lettermill.operators.ranking import UID_BLOCK, number_rows
from lettermill.schema import FOLDER_KEY, GMAIL_HOST, MESSAGE_KEY, TRASH_FOLDER, TRASH_LABEL
from lettermill.session import attach

DELETE_METHODS = ("auto", "delete", "delete-noexpunge", "gmail-trash")


def mark(messages: DataFrame, condition: Column, how: str) -> DataFrame:
    """Set or clear a flag on matching messages; doing it twice changes nothing."""
    flag, value = MARKS[how]
    return messages.withColumn(flag, F.when(condition, F.lit(value)).otherwise(F.col(flag)))


def mark_by_key(messages: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Set or clear a flag on exactly the listed messages (unique keys)."""
    hits = keys.select(*MESSAGE_KEY, F.lit(True).alias("_hit"))
    return mark(messages.join(hits, MESSAGE_KEY, "left"), F.col("_hit").isNotNull(), how).drop("_hit")


def delete_method(host: Column, folder: Column) -> Column:
    """What ``auto`` means in a folder of an account."""
    return F.when((host == GMAIL_HOST) & (folder != TRASH_FOLDER), F.lit("gmail-trash")).otherwise(
        F.lit("delete")
    )


def resolve_delete_method(rows: DataFrame, accounts: DataFrame, method: str = "auto") -> DataFrame:
    """Add ``method`` to message rows, looking up the host of their account."""
    if method != "auto":
        return rows.withColumn("method", F.lit(method))
    hosts = accounts.select("account", F.col("host").alias("_host"))
    return (
        attach(rows, hosts, ["account"], salt_by="uid" if "uid" in rows.columns else "folder")
        .withColumn("method", delete_method(F.col("_host"), F.col("folder")))
        .drop("_host")
    )


def flag_deleted(messages: DataFrame, condition: Column) -> DataFrame:
    """Set the deleted flag only; see ``close_folder``."""
    return messages.withColumn("deleted", F.col("deleted") | condition)


def expunge(messages: DataFrame, condition: Column) -> DataFrame:
    """Delete matching messages.

    Every message already flagged as deleted goes with them when it is in a
    folder where something matched; other folders are left alone.
    """
    return _after_expunge(messages.filter(~condition), messages.filter(condition))


def _after_expunge(rest: DataFrame, gone: DataFrame) -> DataFrame:
    """``rest`` without flagged messages in the folders ``gone`` was taken from.

    Only messages with the flag, normally few, take part in the join.
    """
    touched = gone.select(*FOLDER_KEY).distinct()
    stale = attach(rest.filter("deleted"), touched, FOLDER_KEY, "left_anti")
    return rest.filter("not deleted").unionByName(stale.select(*rest.columns))


def close_folder(messages: DataFrame, folders: Column) -> DataFrame:
    """Closing a folder removes its messages flagged as deleted."""
    return messages.filter(~(F.col("deleted") & folders))


def last_uids(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``account``, ``folder`` and ``uid``: the largest UID that a trash folder ever had.

    ``known`` is such a table of before; mail it counted may be gone since.
    """
    rows = messages.filter(F.col("folder") == TRASH_FOLDER).select(*MESSAGE_KEY)
    rows = rows if known is None else rows.unionByName(known.select(*MESSAGE_KEY))
    return rows.groupBy(*FOLDER_KEY).agg(F.max("uid").alias("uid"))


def gmail_trash(messages: DataFrame, condition: Column, used: DataFrame | None = None) -> DataFrame:
    """Label matching messages as trash and move them to the trash folder.

    Moved messages get new UIDs there, in order of their old folder and UID, after those in
    the folder and after those in ``used`` (see :func:`last_uids`): without it, UIDs of an
    emptied folder would be given out again.
    """
    moving = condition & (F.col("folder") != TRASH_FOLDER)
    stay = messages.filter(~moving).withColumn("labels", F.when(
        condition, _with_trash_label()).otherwise(F.col("labels")))
    return stay.unionByName(_moved_to_trash(messages.filter(moving), messages, used))


def _with_trash_label() -> Column:
    return F.array_union("labels", F.array(F.lit(TRASH_LABEL)))


def _moved_to_trash(moving: DataFrame, messages: DataFrame, used: DataFrame | None = None) -> DataFrame:
    last_uid = last_uids(messages, used).select("account", F.col("uid").alias("_base"))
    moved = number_rows(
        moving.withColumn("_uid_block", F.expr(f"uid div {UID_BLOCK}")),
        ["account"],
        [["folder"], ["_uid_block"]],
        ["folder", "uid"],
        "_position",
        last_uid,
    )
    return (
        moved.withColumn("folder", F.lit(TRASH_FOLDER))
        .withColumn("uid", F.col("_position") + 1)
        .withColumn("labels", _with_trash_label())
        .select(*moving.columns)
    )


def delete(
    messages: DataFrame, condition: Column, method: str = "auto", accounts: DataFrame | None = None,
    used: DataFrame | None = None,
) -> DataFrame:
    """Delete matching messages by one method, or by the one each folder calls for.

    ``used`` holds the UIDs that trash folders had, see :func:`gmail_trash`.
    """
    if method == "delete":
        return expunge(messages, condition)
    if method == "delete-noexpunge":
        return flag_deleted(messages, condition)
    if method == "gmail-trash":
        return gmail_trash(messages, condition, used)
    if method != "auto" or accounts is None:
        raise ValueError(f"delete method must be one of {DELETE_METHODS}; auto needs accounts")
    # Only matching messages are looked up; the others are just passed on.
    hits = resolve_delete_method(messages.filter(condition), accounts).select(
        *messages.columns, "method"
    )
    trashed = hits.filter("method = 'gmail-trash'").drop("method")
    expunged = hits.filter("method = 'delete'").drop("method")
    rest = _after_expunge(messages.filter(~condition), expunged)
    return rest.unionByName(_moved_to_trash(trashed, messages, used))
