"""The given tables read as a mailbox: one message per event row.

Each mapping exists twice, as Spark expressions here and as SQL text in
``SQL``, so that a query and its SQL statement start from the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 31)
# A week before this day the first mail arrived.
MAIL_NOW = dt.datetime(2024, 1, 9)

_FOLDERS = ["INBOX", "[Gmail]/All Mail", "Receipts", "[Gmail]/Spam", "[Gmail]/Trash"]

MESSAGES_SQL = """
msgs as (
  select event_id uid, cast(user_id%5 as int) account_idx,
    'acct'||cast(user_id%5 as varchar) account,
    case when user_id%5=0 then 'imap.gmail.com' else 'imap.example.com' end host,
    case event_type when 'click' then 'INBOX' when 'view' then '[Gmail]/All Mail'
      when 'purchase' then 'Receipts' when 'error' then '[Gmail]/Spam'
      else '[Gmail]/Trash' end folder,
    case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2
      when 'error' then 3 else 4 end folder_idx,
    ts internal_date,
    cast(regexp_extract(props,'([0-9]+)',1) as int)%2=0 seen,
    cast(regexp_extract(props,'([0-9]+)',1) as int)%3=0 flagged,
    cast(floor(value*1000) as bigint) size,
    case user_id%3 when 0 then 'user'||cast(user_id as varchar)||'@github.com'
      when 1 then 'notifications@github.com'
      else 'user'||cast(user_id as varchar)||'@example.com' end from_addr
  from events)"""

MAILS_SQL = (
    MESSAGES_SQL
    + """,
mails as (
  select m.*,
    'From: '||'list-'||d.lang||'@example.com'||chr(13)||chr(10)||chr(13)||chr(10) header,
    replace(d.text,chr(10),chr(13)||chr(10)) body
  from msgs m join documents d on d.doc_id=m.uid%(select count(*) from documents)),
clean as (
  select account_idx, account, folder_idx, folder, uid,
    replace(header,chr(13)||chr(10),chr(10)) header,
    replace(body,chr(13)||chr(10),chr(10)) body
  from mails),
hashed as (
  select account_idx, account, folder_idx, folder, uid,
    sha256(header||body) msg_hash,
    cast(strlen(header)+strlen(body) as bigint) length
  from clean),
named as (
  select *, row_number() over (partition by msg_hash
      order by account_idx, folder_idx, uid) - 1 dup_no
  from hashed)"""
)

# Seven folders per account; one is always empty, one cannot be opened.
FOLDERS_SQL = """
accts as (
  select distinct cast(user_id%5 as int) account_idx,
    'acct'||cast(user_id%5 as varchar) account,
    case when user_id%5=0 then 'imap.gmail.com' else 'imap.example.com' end host
  from events),
all_folders as (
  select account_idx, account, host, folder_idx, folder from accts cross join
    (values (0,'INBOX'),(1,'[Gmail]/All Mail'),(2,'Receipts'),(3,'[Gmail]/Spam'),
            (4,'[Gmail]/Trash'),(5,'Empty'),(6,'[Gmail]')) f(folder_idx, folder)),
folders as (select * from all_folders where folder <> '[Gmail]')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _account_idx():
    return F.expr("cast(user_id % 5 as int)")


def _host():
    return F.expr("if(user_id % 5 = 0, 'imap.gmail.com', 'imap.example.com')")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    k = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
    folder_idx = "case event_type when 'click' then 0 when 'view' then 1 " \
                 "when 'purchase' then 2 when 'error' then 3 else 4 end"
    folder = "element_at(array(" + ", ".join(f"'{f}'" for f in _FOLDERS) + f"), {folder_idx} + 1)"
    return events.select(
        _account_idx().alias("account_idx"),
        F.expr("concat('acct', user_id % 5)").alias("account"),
        F.expr(folder_idx).alias("folder_idx"),
        F.expr(folder).alias("folder"),
        F.col("event_id").alias("uid"),
        F.col("ts").alias("internal_date"),
        F.expr("cast(floor(value * 1000) as bigint)").alias("size"),
        F.expr(
            "case user_id % 3 when 0 then concat('user', user_id, '@github.com') "
            "when 1 then 'notifications@github.com' "
            "else concat('user', user_id, '@example.com') end"
        ).alias("from_addr"),
        F.expr(f"{k} % 2 = 0").alias("seen"),
        F.expr(f"{k} % 3 = 0").alias("flagged"),
        F.lit(False).alias("deleted"),
        F.array().cast("array<string>").alias("labels"),
        F.expr(folder).alias("origin_folder"),
        F.col("event_id").alias("origin_uid"),
    )


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with header and body as text; the documents are dealt out in turn."""
    return mails_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents"))


def mails_of(events: DataFrame, documents: DataFrame) -> DataFrame:
    return with_documents(messages_of(events), documents)


def with_documents(messages: DataFrame, documents: DataFrame, once: bool = False) -> DataFrame:
    """Add header and body to rows with the ``uid`` of a message; ``once`` for a document that
    is there several times."""
    docs = documents.select(
        F.col("doc_id").alias("_doc"),
        F.concat(
            F.lit("From: list-"), F.col("lang"), F.lit("@example.com\r\n\r\n")
        ).alias("header"),
        F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("body"),
    )
    if once:
        docs = docs.repartition("_doc").distinct()
    turn = F.col("uid") % documents.count()
    return messages.withColumn("_doc", turn).join(docs, "_doc").drop("_doc")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select(_account_idx().alias("account_idx"), _host().alias("host"))
        .distinct()
        .select(
            "account_idx",
            F.concat(F.lit("acct"), F.col("account_idx")).alias("account"),
            "host",
            F.lit(993).alias("port"),
            F.concat(F.lit("user"), F.col("account_idx")).alias("user"),
        )
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(f) for f in [*_FOLDERS, "Empty", "[Gmail]"]])
    return accounts(spark, sf_dir).select(
        "account_idx", "account", "host", F.posexplode(names).alias("folder_idx", "folder")
    ).withColumn("delimiter", F.lit("/")).withColumn(
        "attributes",
        F.when(F.col("folder") == "[Gmail]", F.array(F.lit("\\Noselect"), F.lit("\\HasChildren")))
        .otherwise(F.array(F.lit("\\HasNoChildren"))),
    )
