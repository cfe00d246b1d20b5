"""Deliveries and outcomes derived from the mailbox of ``checks.mailbox``.

Unseen mail is fetched in chunks of 150; some deliveries fail by rule, so that
every delivery mode has something to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import mailbox as mb
from lettermill.operators.ranking import chunk

# A message fails when its account and UID say so; one folder of one account
# fails as a whole.
_OK = (
    "not ((uid % 7 = 0 and account_idx >= 2) or (folder_idx = 2 and account_idx = 1))"
)

DELIVERIES_SQL = (
    mb.MESSAGES_SQL
    + f""",
positioned as (
  select *, row_number() over (partition by account, folder order by uid) - 1 position
  from msgs where not seen),
deliveries as (
  select account_idx, account, 0 command_idx, folder_idx, folder,
    position // 150 batch_id, uid, {_OK} ok
  from positioned),
batches as (
  select account_idx, account, folder_idx, folder, batch_id,
    count(*) filter (where ok) d, count(*) filter (where not ok) u
  from deliveries group by all)"""
)

OUTCOMES_SQL = (
    mb.MESSAGES_SQL
    + """,
outcomes as (
  select account_idx, account, 0 command_idx, folder_idx, folder, 'fetch' command, uid,
    case when uid%101=0 then 'conflict' when uid%7=0 then 'failed'
      when uid%11=0 then 'delivered_unmarked' else 'marked' end status
  from msgs where not seen
  union all
  select account_idx, account, 1, folder_idx, folder, 'mark', uid, 'marked'
  from msgs where seen and not flagged and account_idx <> 3
  union all
  select account_idx, account, 2, folder_idx, folder, 'delete', uid,
    case when host='imap.gmail.com' and folder<>'[Gmail]/Trash' then 'trashed'
      else 'deleted' end
  from msgs where seen and cast(internal_date as date) < date '2024-01-10'
  union all
  select account_idx, account, 0, folder_idx, folder, 'fetch', null, 'error'
  from msgs where not seen and uid%7=0
  group by account_idx, account, folder_idx, folder)"""
)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    unseen = mb.messages(spark, sf_dir).filter("not seen")
    return chunk(unseen, 150).select(
        "account_idx", "account", F.lit(0).alias("command_idx"), "folder_idx", "folder",
        F.col("chunk").alias("batch_id"), "uid", F.expr(_OK).alias("ok"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = mb.messages(spark, sf_dir)
    where = ["account_idx", "account", "folder_idx", "folder"]

    def rows(selected: DataFrame, idx: int, command: str, status) -> DataFrame:
        return selected.select(
            F.lit(0).cast("bigint").alias("cycle_id"), F.lit(idx).alias("command_idx"), *where,
            F.lit(command).alias("command"), "uid", F.lit(None).cast("bigint").alias("batch_id"),
            status.alias("status"), F.lit(None).cast("string").alias("detail"),
        )

    unseen = msgs.filter("not seen")
    fetched = rows(unseen, 0, "fetch", F.expr(
        "case when uid % 101 = 0 then 'conflict' when uid % 7 = 0 then 'failed' "
        "when uid % 11 = 0 then 'delivered_unmarked' else 'marked' end"
    ))
    marked = rows(
        msgs.filter("seen and not flagged and account_idx <> 3"), 1, "mark", F.lit("marked")
    )
    old = F.col("internal_date").cast("date") < F.lit("2024-01-10").cast("date")
    deleted = rows(
        msgs.filter(F.col("seen") & old), 2, "delete",
        F.when((F.col("account_idx") == 0) & (F.col("folder") != "[Gmail]/Trash"), "trashed")
        .otherwise("deleted"),
    )
    failing = unseen.filter("uid % 7 = 0").groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    errors = rows(
        failing.withColumn("uid", F.lit(None).cast("bigint")), 0, "fetch", F.lit("error")
    ).withColumn("detail", F.concat(F.lit("failed in "), F.col("folder")))
    return fetched.unionByName(marked).unionByName(deleted).unionByName(errors)
