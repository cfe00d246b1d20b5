"""What must not happen any more after something went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_STATUSES = ("error", "conflict")


def guard_delete(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add ``guarded`` to the folders a delete would visit.

    True when the account had any error earlier in the cycle.  Errors are first
    reduced to the earliest one per account.
    """
    position = F.struct("command_idx", "folder_idx")
    first = (
        outcomes.filter(F.col("status").isin(*ERROR_STATUSES))
        .groupBy("account")
        .agg(F.min(F.struct("command_idx", F.coalesce("folder_idx", F.lit(-1)).alias("folder_idx")))
             .alias("_first"))
    )
    return (
        units.join(first, "account", "left")
        .withColumn("guarded", F.coalesce(F.col("_first") < position, F.lit(False)))
        .drop("_first")
    )


def isolate_failures(units: DataFrame, failures: DataFrame) -> DataFrame:
    """Add ``status`` (ok / failed / skipped) to units of work.

    ``units`` has account_idx, account, command_idx, folder_idx; ``failures``
    has account, command_idx, folder_idx and ``kind``: a *folder* failure ends
    that unit only, an *account* failure also the rest of its account, a *run*
    failure everything after it.  Accounts are worked on one after another.
    """
    here = ["account", "command_idx", "folder_idx"]
    in_account = F.struct("command_idx", "folder_idx")
    in_run = F.struct("account_idx", "command_idx", "folder_idx")
    severity = F.array_position(F.array(*map(F.lit, ("folder", "account", "run"))), F.col("kind"))
    failed = failures.groupBy(*here).agg(F.max_by("kind", severity).alias("_kind"))
    marked = units.join(failed, here, "left")
    stops = (
        marked.filter(F.col("_kind").isin("account", "run"))
        .groupBy("account")
        .agg(F.min(in_account).alias("_stop"))
    )
    judged = marked.join(stops, "account", "left").withColumn(
        "_skipped", F.coalesce(in_account > F.col("_stop"), F.lit(False))
    )
    run_stop = (
        judged.filter((F.col("_kind") == "run") & ~F.col("_skipped")).agg(F.min(in_run)).scalar()
    )
    skipped = F.col("_skipped") | F.coalesce(in_run > run_stop, F.lit(False))
    return judged.withColumn(
        "status",
        F.when(skipped, "skipped").when(F.col("_kind").isNotNull(), "failed").otherwise("ok"),
    ).drop("_kind", "_stop", "_skipped")
