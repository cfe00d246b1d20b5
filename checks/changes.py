"""Numbering, batches, delivery outcomes, state changes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mailbox as mb
from checks import outcomes as oc
from checks.registry import query
from lettermill.operators import delivery as dlv
from lettermill.operators import reports as rep
from lettermill.operators import transitions as tr
from lettermill.operators.batching import batch_totals, size_batches
from lettermill.operators.filters import MARKS, MessageFilter, default_filter
from lettermill.operators.ranking import chunk
from lettermill.operators.safety import guard_delete, isolate_failures

_STATE = ["account", "folder", "uid", "seen", "flagged", "deleted"]
_NUMBERED = f"""with {mb.MESSAGES_SQL},
numbered as (select *, row_number() over (partition by account, folder order by uid) - 1 position
  from msgs where not seen)"""


# -- numbering and batches ----------------------------------------------------


@query(_NUMBERED + " select account, folder, uid, position // 150 chunk from numbered")
def chunks(spark, sf_dir):
    return chunk(mb.messages(spark, sf_dir).filter("not seen")).select(
        "account", "folder", "uid", "chunk"
    )


@query(_NUMBERED + """ select account, folder, position // 150 chunk, count(*) messages,
  cast(sum(size) as bigint) bytes from numbered group by all""", name="batch_totals")
def _batch_totals(spark, sf_dir):
    return batch_totals(chunk(mb.messages(spark, sf_dir).filter("not seen")), "chunk")


# One step of the recursion is one pass over the waiting messages of a chunk:
# a fold that lets messages join the open batch or leaves them behind.  When
# something is left behind the batch closes; an empty one takes a single message.
_PACK = f"""with recursive {mb.MESSAGES_SQL},
numbered as (select account, folder, uid, size,
    (row_number() over (partition by account, folder order by uid) - 1) // 150 chunk
  from msgs where not seen),
chunked as (select account, folder, chunk, list({{'uid': uid, 'size': size}} order by uid) queue
  from numbered group by all),
packing(account, folder, chunk, label, next_label, n, bytes, waiting, joined) as (
  select account, folder, cast(-1 as bigint), cast(0 as bigint), cast(0 as bigint),
    cast(0 as bigint), cast(0 as bigint), cast([] as struct(uid bigint, size bigint)[]),
    cast([] as bigint[])
  from chunked where chunk = 0
  union all
  select account, folder, chunk, next_label,
    case when len(st.behind) > 0 then next_label + 1 else next_label end,
    case when len(st.behind) > 0 then 0 else st.n end,
    case when len(st.behind) > 0 then 0 else st.bytes end,
    case when len(st.behind) > 0 and st.n = 0 then st.behind[2:] else st.behind end,
    case when len(st.behind) > 0 and st.n = 0 then [st.behind[1].uid] else st.joined end
  from (
    select p.account, p.folder, p.next_label,
      case when len(p.waiting) = 0 then p.chunk + 1 else p.chunk end chunk,
      list_reduce(
        list_transform(case when len(p.waiting) = 0 then c.queue else p.waiting end,
          lambda m: {{'n': cast(0 as bigint), 'bytes': m.size, 'joined': [m.uid], 'behind': [m]}}),
        lambda a, m: case when a.n < 150 and a.bytes + m.bytes < 4194304
          then {{'n': a.n + 1, 'bytes': a.bytes + m.bytes,
            'joined': list_concat(a.joined, m.joined), 'behind': a.behind}}
          else {{'n': a.n, 'bytes': a.bytes, 'joined': a.joined,
            'behind': list_concat(a.behind, m.behind)}} end,
        {{'n': p.n, 'bytes': p.bytes, 'joined': cast([] as bigint[]),
          'behind': cast([] as struct(uid bigint, size bigint)[])}}) st
    from packing p left join chunked c
      on c.account = p.account and c.folder = p.folder and c.chunk = p.chunk + 1
    where len(p.waiting) > 0 or c.chunk is not null)),
packed as (select account, folder, unnest(joined) uid, label from packing)"""


@query(_PACK + """ select account, folder, uid, size, label batch_id
from packed join numbered using (account, folder, uid)""", name="size_batches")
def _size_batches(spark, sf_dir):
    return size_batches(mb.messages(spark, sf_dir).filter("not seen"))


# -- deliveries -----------------------------------------------------------------

_JUDGED_CAREFUL = f"""with {oc.DELIVERIES_SQL},
stops as (select *, coalesce(max(case when u > 0 and d = 0 then 1 else 0 end) over (
    partition by account order by folder_idx, batch_id
    rows between unbounded preceding and 1 preceding), 0) = 1 late from batches)"""

_JUDGED_PARANOID = f"""with {oc.DELIVERIES_SQL},
in_account as (select *, coalesce(max(case when u > 0 and d = 0 then 1 else 0 end) over (
    partition by account order by folder_idx, batch_id
    rows between unbounded preceding and 1 preceding), 0) = 1 late0 from batches),
stops as (select *, late0 or coalesce(max(case when u > 0 and d > 0 and not late0 then 1 else 0 end)
    over (order by account_idx, folder_idx, batch_id
      rows between unbounded preceding and 1 preceding), 0) = 1 late from in_account)"""

_BACK = "from deliveries d join stops s using (account, folder, batch_id)"


def _modes(name: str, mode: str, sql: str) -> None:
    query(sql, name)(
        lambda spark, sf_dir: dlv.delivery_outcome(oc.deliveries(spark, sf_dir), mode).select(
            "account", "folder", "batch_id", "uid", "status"
        )
    )


_modes("delivery_yolo", "yolo", f"""with {oc.DELIVERIES_SQL}
select account, folder, batch_id, uid, case when ok then 'marked' else 'failed' end status
from deliveries""")
_modes("delivery_careful", "careful", _JUDGED_CAREFUL + f"""
select account, folder, batch_id, uid,
  case when late then 'not_attempted' when ok then 'marked' else 'failed' end status {_BACK}""")
_modes("delivery_paranoid", "paranoid", _JUDGED_PARANOID + f"""
select account, folder, batch_id, uid,
  case when late then 'not_attempted' when not ok then 'failed'
    when u > 0 then 'delivered_unmarked' else 'marked' end status {_BACK}""")


@query(_JUDGED_CAREFUL + """, failing as (select * from stops where u > 0 and not late)
select account, folder, batch_id, u||
  case when u=1 then ' message' else ' messages' end||' not delivered to `disk`' detail from failing
union all
select account, folder, batch_id, 'nothing of a batch was delivered: '
  ||'the rest of this fetch and later commands of the account are left out' from failing where d = 0""", name="delivery_errors")
def _delivery_errors(spark, sf_dir):
    judged = dlv.judge_batches(dlv.batch_summary(oc.deliveries(spark, sf_dir)), "careful")
    return dlv.delivery_errors(judged, "disk").select("account", "folder", "batch_id", "detail")


_MISSING = _NUMBERED + """,
requested as (select account, folder, uid, position // 150 chunk from numbered),
broken as (select distinct account, folder, chunk from requested where uid % 499 = 0)"""


def _answers(spark, sf_dir):
    requested = chunk(mb.messages(spark, sf_dir).filter("not seen")).select(
        "account", "folder", "uid", "chunk"
    )
    return dlv.missing_responses(requested, requested.filter("uid % 499 <> 0"))


@query(_MISSING + " select r.* from requested r join broken using (account, folder, chunk)",
       name="missing_responses")
def _missing_responses(spark, sf_dir):
    """One message in 499 gets no answer; its whole chunk counts as undelivered."""
    return _answers(spark, sf_dir)[0].select("account", "folder", "uid", "chunk")


@query(_MISSING + " select account, folder, chunk, 'error' status from broken")
def missing_response_errors(spark, sf_dir):
    return _answers(spark, sf_dir)[1].select("account", "folder", "chunk", "status")


@query(f"""with {mb.MESSAGES_SQL} select account, folder, uid,
  case when uid%50=0 then 'conflict' else 'complete' end status from msgs""", name="conflicts")
def _conflicts(spark, sf_dir):
    answers = mb.messages(spark, sf_dir).withColumn(
        "size", F.when(F.col("uid") % 50 != 0, F.col("size"))
    )
    good, bad = dlv.conflicts(answers, ["uid", "size"])
    columns = ["account", "folder", "uid", "status"]
    return good.withColumn("status", F.lit("complete")).select(*columns).unionByName(
        bad.select(*columns)
    )


# -- state changes -----------------------------------------------------------------

_FLAG_SQL = {
    "seen": "true seen, flagged", "unseen": "false seen, flagged",
    "flagged": "seen, true flagged", "unflagged": "seen, false flagged",
}


def _marking(how: str) -> None:
    chosen = default_filter("mark", MessageFilter(newer_than_days=(20,)), how)
    flag, value = MARKS[how]
    other = "flagged" if flag == "seen" else "seen"
    changed = f"case when not cast(internal_date as date) < date '2024-01-11' then {value} " \
              f"else {flag} end {flag}"
    query(f"with {mb.MESSAGES_SQL} select account, folder, uid, {changed}, {other},"
          f" false deleted from msgs", f"mark_{how}")(
        lambda spark, sf_dir: tr.mark(
            mb.messages(spark, sf_dir), chosen.column(mb.NOW), how
        ).select(*_STATE)
    )


for _how in MARKS:
    _marking(_how)


@query(f"""with {mb.MESSAGES_SQL} select m.account, m.folder, m.uid,
  m.seen or d.lang = 'de' seen, m.flagged, false deleted
from msgs m join documents d on d.doc_id = m.uid % (select count(*) from documents)""", name="mark_by_key")
def _mark_by_key(spark, sf_dir):
    """Mark exactly the messages from one list: those whose content is in one language."""
    german = F.startswith("header", F.lit("From: list-de@"))
    keys = mb.mails(spark, sf_dir).filter(german).select("account", "folder", "uid")
    return tr.mark_by_key(mb.messages(spark, sf_dir), keys, "seen").select(*_STATE)


# Some mail is already flagged as deleted: what is flagged and from one day.
_STALE = "(flagged and cast(internal_date as date) = date '2024-01-20')"
_STALE_SQL = mb.MESSAGES_SQL + f""",
state as (select *, {_STALE} deleted,
  seen and cast(internal_date as date) < date '2024-01-24' and folder in ('INBOX','Receipts')
    and account <> 'acct2' hit
  from msgs)"""


def _hit():
    return (
        MessageFilter(seen=True, older_than_days=(7,)).column(mb.NOW)
        & F.col("folder").isin("INBOX", "Receipts")
        & (F.col("account") != "acct2")
    )


def _stale(spark, sf_dir):
    return mb.messages(spark, sf_dir).withColumn("deleted", F.expr(_STALE))


@query(f"""with {_STALE_SQL},
touched as (select distinct account, folder from state where hit)
select account, folder, uid, seen, flagged, s.deleted from state s
left join touched t using (account, folder)
where not s.hit and not (s.deleted and t.folder is not null)""")
def delete(spark, sf_dir):
    """Expunging takes mail flagged earlier with it, in the same folders only."""
    return tr.delete(_stale(spark, sf_dir), _hit(), "delete").select(*_STATE)


@query(f"""with {_STALE_SQL}
select account, folder, uid, seen, flagged, deleted or hit deleted from state
where not ((deleted or hit) and folder in ('INBOX','[Gmail]/Spam'))""")
def delete_noexpunge_closed(spark, sf_dir):
    """Flagging only; then two folders are closed."""
    flagged = tr.delete(_stale(spark, sf_dir), _hit(), "delete-noexpunge")
    return tr.close_folder(flagged, F.col("folder").isin("INBOX", "[Gmail]/Spam")).select(*_STATE)


@query(f"""with {_STALE_SQL},
last as (select account, max(uid) top from msgs where folder='[Gmail]/Trash' group by account),
moved as (select s.account, '[Gmail]/Trash' folder,
    coalesce(top, 0) + row_number() over (partition by s.account order by s.folder, s.uid) uid,
    seen, flagged, deleted, 1 n_labels
  from state s left join last using (account) where hit)
select account, folder, cast(uid as bigint) uid, seen, flagged, deleted, n_labels from moved
union all select account, folder, uid, seen, flagged, deleted, 0 from state where not hit""")
def gmail_trash(spark, sf_dir):
    return tr.delete(_stale(spark, sf_dir), _hit(), "gmail-trash").select(
        *_STATE, F.size("labels").alias("n_labels")
    )


@query(f"""with {_STALE_SQL},
last as (select account, max(uid) top from msgs where folder='[Gmail]/Trash' group by account),
moved as (select s.account, '[Gmail]/Trash' folder,
    coalesce(top, 0) + row_number() over (partition by s.account order by s.folder, s.uid) uid,
    seen, flagged, deleted
  from state s left join last using (account) where hit and host='imap.gmail.com'),
touched as (select distinct account, folder from state where hit and host<>'imap.gmail.com')
select account, folder, cast(uid as bigint) uid, seen, flagged, deleted from moved
union all
select account, folder, uid, seen, flagged, s.deleted from state s
left join touched t using (account, folder)
where not s.hit and not (s.deleted and t.folder is not null)""")
def delete_auto(spark, sf_dir):
    """Each account's host decides the method."""
    return tr.delete(
        _stale(spark, sf_dir), _hit(), "auto", mb.accounts(spark, sf_dir)
    ).select(*_STATE)


@query(f"""with {mb.MESSAGES_SQL} select account, folder, uid,
  case when host='imap.gmail.com' and folder<>'[Gmail]/Trash' then 'gmail-trash'
    else 'delete' end as method
from msgs where seen and cast(internal_date as date) < date '2024-01-24'""", name="delete_method")
def _delete_method(spark, sf_dir):
    chosen = MessageFilter(seen=True, older_than_days=(7,)).column(mb.NOW)
    return tr.resolve_delete_method(
        mb.messages(spark, sf_dir).filter(chosen), mb.accounts(spark, sf_dir)
    ).select("account", "folder", "uid", "method")


@query(f"""with {oc.OUTCOMES_SQL}, {mb.FOLDERS_SQL},
failing as (select account, min(command_idx*1000 + folder_idx) first from outcomes
  where status in ('error','conflict') group by account)
select account, 2 command_idx, folder,
  coalesce(first < 2*1000 + folder_idx, false) guarded
from folders left join failing using (account)""")
def guarded_delete(spark, sf_dir):
    """Accounts with an error earlier in the cycle are not deleted from."""
    units = mb.folders(spark, sf_dir).filter("folder <> '[Gmail]'").withColumn(
        "command_idx", F.lit(2)
    )
    return guard_delete(units, oc.outcomes(spark, sf_dir)).select("account", "command_idx", "folder", "guarded")


@query(f"""with {oc.OUTCOMES_SQL}, {mb.FOLDERS_SQL},
units as (select account_idx, account, c.i command_idx, folder_idx, folder from folders
  cross join (values (0),(1),(2)) c(i)),
failures as (select account, command_idx, folder_idx,
    case when account_idx=3 and folder_idx=1 then 'run'
      when account_idx=1 and folder_idx=3 then 'account' else 'folder' end kind
  from outcomes where status='error'),
marked as (select u.*, f.kind from units u
  left join failures f using (account, command_idx, folder_idx)),
in_account as (select *, coalesce(max(case when kind in ('account','run') then 1 else 0 end) over (
    partition by account order by command_idx, folder_idx
    rows between unbounded preceding and 1 preceding), 0) = 1 skip0 from marked),
in_run as (select *, skip0 or coalesce(max(case when kind='run' and not skip0 then 1 else 0 end)
    over (order by account_idx, command_idx, folder_idx
      rows between unbounded preceding and 1 preceding), 0) = 1 skipped from in_account)
select account, command_idx, folder,
  case when skipped then 'skipped' when kind is not null then 'failed' else 'ok' end status
from in_run""", name="isolate_failures")
def _isolate_failures(spark, sf_dir):
    units = mb.folders(spark, sf_dir).filter("folder <> '[Gmail]'").withColumn(
        "command_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )
    failures = oc.outcomes(spark, sf_dir).filter("status = 'error'").select("account", "command_idx", "folder_idx", F.expr(
        "case when account_idx = 3 and folder_idx = 1 then 'run' "
        "when account_idx = 1 and folder_idx = 3 then 'account' else 'folder' end kind"
    ))
    return isolate_failures(units, failures).select("account", "command_idx", "folder", "status")


# -- reports --------------------------------------------------------------------

_COUNTERS_SQL = """
  count(*) filter (where command='fetch' and status in ('marked','delivered_unmarked')) delivered,
  count(*) filter (where status='failed') undelivered,
  count(*) filter (where status='marked') marked,
  count(*) filter (where status='trashed') trashed,
  count(*) filter (where status='deleted') deleted,
  count(*) filter (where status in ('error','conflict')) errors"""


@query(f"with {oc.OUTCOMES_SQL} select account, {_COUNTERS_SQL} from outcomes group by account",
       name="account_counters")
def _account_counters(spark, sf_dir):
    return rep.account_counters(oc.outcomes(spark, sf_dir))


@query(f"""with {oc.OUTCOMES_SQL} select coalesce(account,'(all)') account,
  coalesce(folder,'(all)') folder, {_COUNTERS_SQL} from outcomes group by rollup(account, folder)""")
def rollup_totals(spark, sf_dir):
    totals = rep.cycle_totals(oc.outcomes(spark, sf_dir))
    return totals.select(
        F.coalesce("account", F.lit("(all)")).alias("account"),
        F.coalesce("folder", F.lit("(all)")).alias("folder"), *rep.COUNTERS,
    )


def _said(column: str, one: str, many: str) -> str:
    return (f"case when {column} > 0 then case when {column} = 1 then '{one}' else '{many}' end end"
            .replace("%d", f"'||{column}||'"))


@query(f"""with {oc.OUTCOMES_SQL},
t as (select {_COUNTERS_SQL} from outcomes)
select *, concat_ws(', ', {_said('delivered', '%d new message fetched', '%d new messages fetched')},
    {_said('marked', '%d message marked', '%d messages marked')},
    {_said('trashed', '%d message put into the trash', '%d messages put into the trash')},
    {_said('deleted', '%d message deleted', '%d messages deleted')}) good,
  concat_ws(', ', {_said('undelivered', '%d message not fetched', '%d messages not fetched')},
    {_said('errors', '%d error', '%d errors')}) bad
from t""", name="cycle_summary")
def _cycle_summary(spark, sf_dir):
    return rep.cycle_summary(oc.outcomes(spark, sf_dir))


_LINES_SQL = f"""with {oc.OUTCOMES_SQL},
t as (select account_idx, account, command_idx, command, folder_idx, folder, {_COUNTERS_SQL}
  from outcomes group by all),
lines as (
  select account_idx, account, command_idx, folder_idx, '`'||folder||'`: '||
    case when command='fetch' then
      case when delivered = marked then delivered||
          case when delivered=1 then ' message' else ' messages' end||' fetched and marked'
        else delivered||' fetched, '||marked||' of them marked' end
    when command='mark' then marked||case when marked=1 then ' message' else ' messages' end||' marked'
    when trashed > 0 then trashed||case when trashed=1 then ' message' else ' messages' end||' put into the trash'
    else deleted||case when deleted=1 then ' message' else ' messages' end||' deleted' end line
  from t where (command='fetch' and delivered > 0) or (command='mark' and marked > 0)
    or trashed > 0 or deleted > 0)"""


@query(_LINES_SQL + """
select account_idx, account, 'user'||account_idx||' on '||
  case when account_idx=0 then 'imap.gmail.com' else 'imap.example.com' end||':'||
  string_agg(chr(10)||'- '||line, '' order by command_idx, folder_idx) text
from lines group by account_idx, account""", name="change_log")
def _change_log(spark, sf_dir):
    return rep.change_log(oc.outcomes(spark, sf_dir), mb.accounts(spark, sf_dir))


@query(f"""with {oc.OUTCOMES_SQL}
select account, 'user'||account_idx||' on '||
  case when account_idx=0 then 'imap.gmail.com' else 'imap.example.com' end||':' title,
  command_idx, folder_idx, coalesce(uid, -1) uid,
  case when status='error' then '- failed in '||folder else '(conflict)' end line
from outcomes where status in ('error','conflict')""", name="error_log")
def _error_log(spark, sf_dir):
    return rep.error_log(oc.outcomes(spark, sf_dir), mb.accounts(spark, sf_dir)).select(
        "account", "title", "command_idx", "folder_idx",
        F.coalesce("uid", F.lit(-1)).alias("uid"),
        F.coalesce("line", F.lit("(conflict)")).alias("line"),
    )


@query(f"""with {oc.OUTCOMES_SQL},
hooks(command_idx, position, hook) as (values (0,0,'index'),(0,1,'notify'),(1,0,'never'),
  (0,2,'index')),
fetched as (select distinct account_idx, command_idx, folder_idx from outcomes
  where command='fetch' and status in ('marked','delivered_unmarked')),
firsts as (select hook, min(account_idx*1000000+command_idx*10000+folder_idx*100+position) first
  from fetched join hooks using (command_idx) group by hook)
select hook, row_number() over (order by first) n from firsts""", name="pending_hooks")
def _pending_hooks(spark, sf_dir):
    hooks = {0: ["index", "notify", "index"], 1: ["never"]}
    return rep.pending_hooks(oc.outcomes(spark, sf_dir), hooks)
