"""Filters, counts, folders and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mailbox as mb
from checks.registry import query
from lettermill.functions import (
    attrs_to_map,
    imap_date,
    imap_quote,
    join_list,
    plural,
    seconds_to_ns,
)
from lettermill.operators.counting import count_by_folder, count_many
from lettermill.operators.filters import MARKS, MessageFilter, default_filter
from lettermill.operators.folders import list_folders, select_folders
from lettermill.plans.commands import Delete, Mark
from lettermill.plans.pipeline import dry_run_lines
from lettermill.session import scratch_path
from lettermill.sources.mailbox import human_count, porcelain_count, read_messages, write_messages

_SELECTED = ("account", "folder", "uid")


def _filtered(condition_of):
    def run(spark, sf_dir):
        return mb.messages(spark, sf_dir).filter(condition_of(spark, sf_dir)).select(*_SELECTED)

    return run


def _where(condition: str) -> str:
    return f"with {mb.MESSAGES_SQL} select account, folder, uid from msgs where {condition}"


def _filter_query(name: str, chosen: MessageFilter, condition: str) -> None:
    query(_where(condition), name)(_filtered(lambda spark, _: chosen.column(mb.NOW, spark)))


_filter_query("older_than_7", MessageFilter(older_than_days=(7,)),
              "cast(internal_date as date) < date '2024-01-24'")
_filter_query("older_than_several", MessageFilter(older_than_days=(3, 12, 7)),
              "cast(internal_date as date) < date '2024-01-19'")
_filter_query("newer_than_7", MessageFilter(newer_than_days=(7,)),
              "not cast(internal_date as date) < date '2024-01-24'")
_filter_query("newer_than_several", MessageFilter(newer_than_days=(9, 2, 4), older_than_days=(-5, 1)),
              "not cast(internal_date as date) < date '2024-01-29'"
              " and cast(internal_date as date) < date '2024-01-30'")
_filter_query("from_not_from",
              MessageFilter(from_contains=("GitHub.com",),
                            from_not_contains=("notifications@github.com",)),
              "contains(lower(from_addr), 'github.com')"
              " and not contains(lower(from_addr), 'notifications@github.com')")
_filter_query("from_literal_text",
              MessageFilter(from_contains=("user1",), from_not_contains=("_", "%", "user1.@")),
              "contains(from_addr, 'user1')")
_filter_query("filter_all", MessageFilter(), "true")
_filter_query("filter_every_term",
              MessageFilter(seen=False, flagged=True, from_contains=("user", "com"),
                            from_not_contains=("user1", "user2"), older_than_days=(2,),
                            newer_than_days=(20,)),
              "not seen and flagged and contains(from_addr,'user') and contains(from_addr,'com')"
              " and not contains(from_addr,'user1') and not contains(from_addr,'user2')"
              " and cast(internal_date as date) < date '2024-01-29'"
              " and not cast(internal_date as date) < date '2024-01-11'")


@query(f"""with {mb.MESSAGES_SQL},
stamp as (select cast(epoch(max(ts)) as bigint) - 12*86400 s from events)
select account, folder, uid from msgs, stamp
where cast(internal_date as date)
  < least(cast(to_timestamp(s) at time zone 'UTC' as date), date '2024-01-24')""")
def older_than_stamp(spark, sf_dir):
    """The cut-off comes from a stamp file: twelve days before the newest message."""
    path = scratch_path(spark, "stamp")
    events = mb.table(spark, sf_dir, "events")
    seconds = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', max(ts)) - 12 * 86400"
    events.agg(F.expr(f"cast({seconds} as string)")).coalesce(1).write.text(path)
    chosen = MessageFilter(older_than_days=(7,), older_than_timestamp_in=(path,))
    return mb.messages(spark, sf_dir).filter(chosen.column(mb.NOW, spark)).select(*_SELECTED)


@query(f"""with {mb.MESSAGES_SQL} select account, folder, uid from msgs
where cast(internal_date as date)
  < (select cast(max(internal_date) - interval 9 day as date) from msgs)""")
def older_than_mtime(spark, sf_dir):
    """The cut-off is when a file was last written: nine days before the newest message."""
    path = scratch_path(spark, "mtime")
    mb.messages(spark, sf_dir).agg(F.max("uid").cast("string")).coalesce(1).write.text(path)
    since = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', max(ts)) - 9 * 86400"
    seconds = mb.table(spark, sf_dir, "events").agg(F.expr(since)).first()[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(folder, seconds * 1000, -1)
    chosen = MessageFilter(older_than_days=(3,), older_than_mtime_of=(path,))
    return mb.messages(spark, sf_dir).filter(chosen.column(mb.NOW, spark)).select(*_SELECTED)


@query(f"""with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL},
counts as (select account, folder, count(*) n from msgs where not seen group by all)
select account_idx, account, folder_idx, folder, coalesce(n, 0) n
from folders left join counts using (account, folder)""")
def count_unseen_by_folder(spark, sf_dir):
    return count_by_folder(
        mb.messages(spark, sf_dir),
        list_folders(mb.folders(spark, sf_dir)),
        MessageFilter(seen=False).column(),
    )


@query(f"""with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL},
counts as (select account, folder, count(*) n from msgs
  where not seen and cast(internal_date as date) < date '2024-01-24' group by all)
select account_idx, account, folder_idx, folder, coalesce(n, 0) n
from folders left join counts using (account, folder)""")
def count_old_unseen_by_folder(spark, sf_dir):
    return count_by_folder(
        mb.messages(spark, sf_dir),
        list_folders(mb.folders(spark, sf_dir)),
        MessageFilter(seen=False, older_than_days=(7,)).column(mb.NOW),
    )


_MANY = {
    "unseen": (MessageFilter(seen=False), "not seen"),
    "starred": (MessageFilter(flagged=True), "flagged"),
    "old": (MessageFilter(older_than_days=(7,)), "cast(internal_date as date) < date '2024-01-24'"),
    "nobody": (MessageFilter(from_contains=("nobody@",)), "false"),
}


@query(f"with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL}, counts as (" + " union all ".join(
    f"select {i} command_idx, '{name}' name, f.account_idx, f.account, f.folder_idx, f.folder,"
    f" count(*) filter (where m.uid is not null and {sql}) n"
    f" from folders f left join msgs m using (account, folder)"
    f" group by f.account_idx, f.account, f.folder_idx, f.folder"
    for i, (name, (_, sql)) in enumerate(_MANY.items())
) + ") select * from counts", name="count_many")
def _count_many(spark, sf_dir):
    return count_many(
        mb.messages(spark, sf_dir),
        list_folders(mb.folders(spark, sf_dir)),
        {name: chosen.column(mb.NOW) for name, (chosen, _) in _MANY.items()},
    )


_STATES = [(s, f) for s in (None, True, False) for f in (None, True, False)]


def _state_sql(seen, flagged) -> str:
    terms = [n if v else f"not {n}" for n, v in (("seen", seen), ("flagged", flagged))
             if v is not None]
    return " and ".join(terms) or "true"


@query(f"with {mb.MESSAGES_SQL} select account, "
       + ", ".join(f"count(*) filter (where {_state_sql(*s)}) n{i}" for i, s in enumerate(_STATES))
       + " from msgs group by account")
def flag_filters(spark, sf_dir):
    """Every combination of the two three-way flag filters."""
    return mb.messages(spark, sf_dir).groupBy("account").agg(*[
        F.count_if(MessageFilter(seen=s, flagged=f).column()).alias(f"n{i}")
        for i, (s, f) in enumerate(_STATES)
    ])


@query(f"with {mb.MESSAGES_SQL} " + " union all ".join(
    f"select '{how}' how, account, folder, count(*) n from msgs where "
    + {"seen": "not seen", "unseen": "seen", "flagged": "not flagged", "unflagged": "flagged"}[how]
    + " group by all" for how in MARKS))
def mark_default_filter(spark, sf_dir):
    """What each kind of marking selects when no flag filter is given."""
    conditions = {how: default_filter("mark", MessageFilter(), how).column() for how in MARKS}
    per_how = F.array(*[
        F.struct(F.lit(how).alias("how"), F.count_if(c).alias("n")) for how, c in conditions.items()
    ])
    counted = mb.messages(spark, sf_dir).groupBy("account", "folder").agg(per_how.alias("counts"))
    return counted.select("account", "folder", F.inline("counts")).filter("n > 0")


_INCLUDE = ("Receipts", "Nowhere", "INBOX", "[Gmail]", "[Gmail]/Spam")
_EXCLUDE = ("[Gmail]/Spam", "[Gmail]/Trash")


@query(f"""with {mb.FOLDERS_SQL},
wanted(pos, folder) as (values (0,'Receipts'),(1,'Nowhere'),(2,'INBOX'),(3,'[Gmail]'))
select a.account_idx, a.account, w.pos folder_idx, w.folder,
  case when f.folder is null then 'error' else 'ok' end status
from accts a cross join wanted w
left join folders f on f.account=a.account and f.folder=w.folder""")
def folder_select(spark, sf_dir):
    """Named folders in the given order; unknown ones are errors."""
    visited, unknown = select_folders(
        mb.folders(spark, sf_dir), _INCLUDE, _EXCLUDE, mb.accounts(spark, sf_dir)
    )
    columns = ["account_idx", "account", "folder_idx", "folder", "status"]
    return visited.withColumn("status", F.lit("ok")).select(*columns).unionByName(
        unknown.select(*columns)
    )


@query(f"""with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL}
select f.account, f.folder, count(m.uid) n from folders f
left join msgs m on m.account=f.account and m.folder=f.folder and not m.seen
where f.folder not in ('INBOX','[Gmail]/Trash') group by f.account, f.folder""")
def everything_except(spark, sf_dir):
    visited, _ = select_folders(
        mb.folders(spark, sf_dir), exclude=("INBOX", "[Gmail]/Trash"),
        accounts=mb.accounts(spark, sf_dir),
    )
    counts = count_by_folder(
        mb.messages(spark, sf_dir), visited, MessageFilter(seen=False).column()
    )
    return counts.select("account", "folder", "n")


@query(f"with {mb.FOLDERS_SQL} select account_idx, account, folder_idx, folder from folders",
       name="list_folders")
def _list_folders(spark, sf_dir):
    return list_folders(mb.folders(spark, sf_dir)).select(
        "account_idx", "account", "folder_idx", "folder"
    )


_PORCELAIN = f"""with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL},
counts as (
  select f.account_idx, f.folder_idx, f.folder, count(m.uid) n from folders f
  left join msgs m on m.account=f.account and m.folder=f.folder and not m.seen
  group by all)"""


@query(_PORCELAIN + " select n||' '||folder line from counts")
def porcelain(spark, sf_dir):
    return porcelain_count(count_unseen_by_folder(spark, sf_dir))


@query(_PORCELAIN + """ select 'folder `'||folder||'` has '||n||
  case when n=1 then ' message' else ' messages' end||' matching (UNSEEN)' line from counts""")
def readable_counts(spark, sf_dir):
    text = MessageFilter(seen=False).bind(mb.NOW).render()
    return human_count(count_unseen_by_folder(spark, sf_dir), text)


_DRY_SQL = f"""with {mb.FOLDERS_SQL}, {mb.MESSAGES_SQL},
counts as (select f.account_idx, f.folder_idx, f.folder, f.host, count(m.uid) n from folders f
  left join msgs m on m.account=f.account and m.folder=f.folder and """


@query(_DRY_SQL + """m.seen and cast(m.internal_date as date) < date '2024-01-24' group by all)
select account_idx, folder_idx, 'dry-run: not '||case when trash then 'moving ' else 'deleting ' end||n||
  ' messages matching (SEEN BEFORE 24-Jan-2024) from folder `'||folder||'`'||
  case when trash then ' to `[Gmail]/Trash`' else '' end line
from (select *, host = 'imap.gmail.com' and folder <> '[Gmail]/Trash' trash from counts)""")
def dry_run(spark, sf_dir):
    command = Delete(filter=MessageFilter(older_than_days=(7,)))
    condition = command.effective_filter().column(mb.NOW)
    counts = count_by_folder(
        mb.messages(spark, sf_dir), list_folders(mb.folders(spark, sf_dir)), condition
    ).withColumn("command", F.lit("delete"))
    return dry_run_lines(counts, command, mb.NOW, mb.accounts(spark, sf_dir))


@query(_DRY_SQL + """not m.flagged group by all)
select account_idx, folder_idx, 'dry-run: not marking as FLAGGED '||n||
  ' messages matching (UNFLAGGED) from folder `'||folder||'`' line from counts""")
def dry_run_mark(spark, sf_dir):
    command = Mark(how="flagged")
    counts = count_by_folder(
        mb.messages(spark, sf_dir), list_folders(mb.folders(spark, sf_dir)),
        command.effective_filter().column(mb.NOW),
    ).withColumn("command", F.lit("mark"))
    return dry_run_lines(counts, command, mb.NOW)


@query("""select event_id uid,
  '"'||replace(replace(props||chr(92)||event_type,chr(92),chr(92)||chr(92)),'"',chr(92)||'"')||'"' quoted,
  day(ts)||'-'||['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(ts)]
    ||'-'||year(ts) day_text from events""")
def quote_and_date(spark, sf_dir):
    return mb.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("uid"),
        imap_quote(F.concat("props", F.lit("\\"), "event_type")).alias("quoted"),
        imap_date(F.col("ts")).alias("day_text"),
    )


@query(f"""with {mb.MESSAGES_SQL}
select account, case when count(*)=1 then '1 message' else count(*)||' messages' end amount,
  string_agg(distinct folder, ', ' order by folder) folder_names
from msgs group by account""")
def plural_text(spark, sf_dir):
    grouped = mb.messages(spark, sf_dir).groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("folder")).alias("names")
    )
    return grouped.select(
        "account", plural(F.col("n"), "%d message", "%d messages").alias("amount"),
        join_list(F.col("names")).alias("folder_names"),
    )


@query("""select event_id uid,
  cast(event_id as bigint)*1000000000 + cast(floor(value*1000) as bigint) % 1000000000 ns
from events""", name="seconds_to_ns")
def _seconds_to_ns(spark, sf_dir):
    """Stamps built from each event, with nine digits after the point."""
    fraction = F.expr("cast(cast(floor(value * 1000) as bigint) % 1000000000 as string)")
    text = F.concat("event_id", F.lit("."), F.lpad(fraction, 9, "0"))
    return mb.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("uid"), seconds_to_ns(text).alias("ns")
    )


@query("""select event_id uid, event_type kind, cast(user_id as varchar) who, 2 n from events""")
def attribute_maps(spark, sf_dir):
    """Attribute lists of each event; the later of two equal names wins."""
    items = F.array(
        F.lit("kind"), F.lit("?"), F.lit("who"), F.col("user_id").cast("string"),
        F.lit("Kind"), F.col("event_type"),
    )
    mapped = mb.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("uid"), attrs_to_map(items).alias("m")
    )
    return mapped.select(
        "uid", F.col("m")["KIND"].alias("kind"), F.col("m")["WHO"].alias("who"),
        F.size("m").alias("n"),
    )


@query(_where("not seen and folder = 'INBOX'"))
def mailbox_scan(spark, sf_dir):
    """Written as a mailbox table, then read back with folder and flag filters."""
    path = scratch_path(spark, "mailbox")
    write_messages(mb.messages(spark, sf_dir).drop("account_idx", "folder_idx"), path)
    wanted = MessageFilter(seen=False).column() & (F.col("folder") == "INBOX")
    return read_messages(spark, path).filter(wanted).select(*_SELECTED)
