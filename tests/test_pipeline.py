import os

import pytest
from pyspark.sql import functions as F

from boxes import NEW, NOW, OLD, keys, mailbox, message
from lettermill.operators import delivery as dlv
from lettermill.operators.delivery import ABORTED
from lettermill.operators.filters import MessageFilter
from lettermill.operators.folders import FolderChoice
from lettermill.operators.reports import account_counters, change_log, cycle_summary, error_log
from lettermill.plans.commands import CallTarget, Count, Delete, Fetch, MaildirTarget, Mark, TableTarget
from lettermill.plans.pipeline import CatastrophicFailure, Mailbox, run_pipeline
from lettermill.session import work_dir
from lettermill.sources.archive_table import read_archive_index, read_archive_table

ALL = FolderChoice()


def rejecting(*bodies):
    return CallTarget(lambda raw, digest: not any(raw.endswith(b) for b in bodies), "fn")


def statuses(result):
    return {(r.account, r.folder, r.uid, r.status) for r in result.outcomes.collect()}


def seen(result):
    return keys(result.messages.filter("seen"))


def test_fetch_into_archive_continues_numbers(spark, tmp_path):
    target = TableTarget(str(tmp_path / "archive"), "host")
    box = mailbox(spark, [message("a", "INBOX", 1), message("b", "Lists", 2),
                          message("b", "Lists", 3, body=b"other"), message("b", "Lists", 4, seen=True)])
    first = run_pipeline(box, [Fetch(target=target)], NOW, cycle_id=0)
    assert len(seen(first)) == 4
    for _ in range(2):  # a repeated cycle replaces what it wrote
        run_pipeline(box, [Fetch(target=target)], NOW, cycle_id=1)
    index = read_archive_index(spark, target.path)
    copies = index.groupBy("msg_hash").agg(F.sort_array(F.collect_list("dup_no")).alias("n"))
    assert sorted(r.n for r in copies.collect()) == [[0, 1], [0, 1, 2, 3]]
    rows = read_archive_table(spark, target.path)
    assert rows.count() == 6
    assert rows.filter(F.sha2(F.concat("header", "body"), 256) != F.col("msg_hash")).count() == 0
    assert change_log(first.outcomes, box.accounts).orderBy("account_idx").first()["text"] == (
        "user-a on imap.example.com:\n- `INBOX`: 1 message fetched and marked")


def test_content_in_its_own_table(spark, tmp_path):
    """A message without content is a conflict: unmarked, and nothing is deleted."""
    rows = [message("a", "INBOX", 1), message("a", "INBOX", 2), message("b", "INBOX", 3)]
    whole = mailbox(spark, rows)
    contents = whole.messages.filter("uid <> 2").select(
        "account", "origin_folder", "origin_uid", "header", "body")
    box = Mailbox(whole.accounts, whole.folders, whole.messages.drop("header", "body"), contents)
    result = run_pipeline(
        box, [Fetch(target=TableTarget(str(tmp_path / "x"))), Delete(folders=ALL)], NOW)
    assert ("a", "INBOX", 2, "conflict") in statuses(result)
    assert keys(result.messages) == [("a", "INBOX", 1), ("a", "INBOX", 2)]
    summary = cycle_summary(result.outcomes).first()
    assert summary["good"] == "2 new messages fetched, 2 messages marked, 1 message deleted"
    assert (summary["undelivered"], summary["errors"]) == (0, 4)


def test_careful_stop_ends_the_account(spark):
    rows = [message("a", "INBOX", 1, body=b"bad"), message("a", "Lists", 2),
            message("b", "INBOX", 3, body=b"bad"), message("b", "INBOX", 4),
            message("b", "Lists", 5)]
    commands = [Fetch(target=rejecting(b"bad")), Mark(how="flagged", folders=ALL), Delete(folders=ALL)]
    result = run_pipeline(mailbox(spark, rows), commands, NOW)
    assert statuses(result) >= {
        ("a", "INBOX", 1, "failed"), ("a", "Lists", 2, "not_attempted"),
        ("b", "INBOX", 3, "failed"), ("b", "INBOX", 4, "marked")}
    assert seen(result) == [("b", "INBOX", 4), ("b", "Lists", 5)]
    assert keys(result.messages.filter("flagged")) == [("b", "INBOX", i) for i in (3, 4)] + [
        ("b", "Lists", 5)]
    assert result.messages.count() == 5  # both accounts had errors: no deletes
    lines = error_log(result.outcomes, mailbox(spark, rows).accounts).filter("account = 'a'")
    assert {r.line for r in lines.collect()} == {
        "- 1 message not delivered to `fn`", f"- {ABORTED}"}


def test_yolo_goes_on(spark):
    rows = [message("a", "INBOX", 1, body=b"bad"), message("a", "Lists", 2)]
    result = run_pipeline(mailbox(spark, rows), [Fetch(target=rejecting(b"bad"), mode="yolo")], NOW)
    assert seen(result) == [("a", "Lists", 2)]


def test_paranoid_failure_ends_the_run(spark):
    rows = [message(a, "INBOX", u) for a in "abc" for u in (1, 2)]
    rows[2] = message("b", "INBOX", 1, body=b"bad")
    box = mailbox(spark, rows, accounts=[(a, "h") for a in "abc"])
    commands = [Mark(how="flagged", folders=ALL), Fetch(target=rejecting(b"bad"), mode="paranoid"),
                Mark(how="unflagged", folders=ALL)]
    with pytest.raises(CatastrophicFailure) as caught:
        run_pipeline(box, commands, NOW)
    result = caught.value.result
    assert seen(result) == [("a", "INBOX", 1), ("a", "INBOX", 2)]
    assert ("b", "INBOX", 2, "delivered_unmarked") in statuses(result)
    # a finished all commands, b stopped after its fetch, c was never reached
    assert keys(result.messages.filter("flagged")) == [("b", "INBOX", 1), ("b", "INBOX", 2)]
    assert {s[0] for s in statuses(result)} == {"a", "b"}


def test_every_message_has_one_outcome(spark):
    rows = [message("a", f, u, body=b"bad" if u % 3 == 0 else b"ok%d" % u)
            for f in ("INBOX", "Lists") for u in range(1, 30)]
    for mode in ("yolo", "careful"):
        command = Fetch(target=rejecting(b"bad"), mode=mode, batch_number=4, fetch_number=6)
        result = run_pipeline(mailbox(spark, rows), [command], NOW)
        per = result.outcomes.filter("uid is not null").groupBy("folder", "uid").count()
        assert per.count() == 58 and per.filter("count <> 1").count() == 0
        done = result.outcomes.filter("status = 'marked'")
        assert keys(done) == seen(result)
        batches = result.outcomes.filter("uid is not null").groupBy("folder", "batch_id").count()
        assert batches.filter("count > 4").count() == 0


def test_commands_see_each_other(spark):
    rows = [message("a", "INBOX", 1), message("a", "INBOX", 2, NEW), message("a", "Lists", 3)]
    commands = [
        Count(filter=MessageFilter(seen=False)), None,
        Mark(how="seen", folders=FolderChoice(exclude=("Lists",))),
        Count(filter=MessageFilter(seen=False)),
        Delete(filter=MessageFilter(older_than_days=(7,)), folders=ALL, dry_run=True),
        Delete(filter=MessageFilter(older_than_days=(7,))),
    ]
    result = run_pipeline(mailbox(spark, rows), commands, NOW, folders=ALL)
    counts = {(r.command_idx, r.account, r.folder): r.n for r in result.counts.collect() if r.n}
    assert counts == {(0, "a", "INBOX"): 2, (0, "a", "Lists"): 1, (2, "a", "Lists"): 1,
                      (3, "a", "INBOX"): 1}
    assert keys(result.messages) == [("a", "INBOX", 2), ("a", "Lists", 3)]


def test_unknown_folder_is_an_error_and_guards_later_deletes(spark):
    rows = [message("a", "INBOX", 1, seen=True), message("a", "Lists", 2, seen=True)]
    command = Delete(folders=FolderChoice(("INBOX", "Gone", "Lists")))
    result = run_pipeline(mailbox(spark, rows), [command], NOW)
    assert keys(result.messages) == [("a", "Lists", 2)]
    assert account_counters(result.outcomes).filter("account = 'a'").first()["errors"] == 2


def test_trash_is_emptied_when_visited_later(spark):
    rows = [message("g", "INBOX", 1, seen=True), message("g", "Lists", 2, seen=True),
            message("g", "[Gmail]/Trash", 3, seen=True), message("a", "INBOX", 4, seen=True)]
    box = mailbox(spark, rows, accounts=(("g", "imap.gmail.com"), ("a", "other")))
    order = FolderChoice(("INBOX", "[Gmail]/Trash", "Lists"))
    result = run_pipeline(box, [Delete(folders=order)], NOW)
    assert keys(result.messages) == [("g", "[Gmail]/Trash", 5)]
    assert result.messages.first()["origin_folder"] == "Lists"
    counters = {r.account: (r.trashed, r.deleted) for r in account_counters(result.outcomes).collect()}
    assert counters == {"g": (2, 2), "a": (0, 1)}


def test_explicit_trash_method(spark):
    rows = [message("a", "INBOX", 1, seen=True), message("a", "[Gmail]/Trash", 3, seen=True)]
    result = run_pipeline(
        mailbox(spark, rows), [Delete(folders=ALL, method="gmail-trash")], NOW)
    assert keys(result.messages) == [("a", "[Gmail]/Trash", 3), ("a", "[Gmail]/Trash", 4)]
    assert account_counters(result.outcomes).first()["trashed"] == 3


def test_closing_removes_flagged_mail(spark):
    rows = [message("a", "INBOX", 1, deleted=True), message("a", "Lists", 2, deleted=True),
            message("a", "Lists", 3, seen=True)]
    counted = run_pipeline(mailbox(spark, rows), [Count(folders=FolderChoice(("INBOX",)))], NOW)
    assert keys(counted.messages) == [("a", "Lists", 2), ("a", "Lists", 3)]
    result = run_pipeline(
        mailbox(spark, rows),
        [Delete(folders=FolderChoice(("Lists",)), method="delete-noexpunge")], NOW)
    assert keys(result.messages) == [("a", "INBOX", 1)]


def hidden_folders(spark, rows):
    """A mailbox with a folder that cannot be opened and one that is not listed."""
    box = mailbox(spark, rows, names=("INBOX", "Closed"))
    attributes = F.when(F.col("folder") == "Closed", F.array(F.lit("\\Noselect"))).otherwise(F.col("attributes"))
    return Mailbox(box.accounts, box.folders.withColumn("attributes", attributes), box.messages)


@pytest.mark.parametrize("how", ["mark", "fetch", "delete", "close"])
def test_only_visited_folders_change(spark, how):
    """Whatever changes has an outcome, and nothing else is handed over."""
    rows = [message("a", f, i, deleted=how == "close") for i, f in enumerate(["INBOX", "Closed", "Unlisted"])]
    box = hidden_folders(spark, rows)
    command = {
        "mark": Mark(how="seen", folders=ALL), "fetch": Fetch(target=CallTarget(lambda raw, digest: True, "fn")),
        "delete": Delete(filter=MessageFilter(seen=False), folders=ALL),
        "close": Mark(how="flagged", filter=MessageFilter(seen=True), folders=ALL),
    }[how]
    result = run_pipeline(box, [command], NOW)
    untouched = {("a", "Closed", 1), ("a", "Unlisted", 2)}
    now = {(r.account, r.folder, r.uid): (r.seen, r.deleted) for r in result.messages.collect()}
    assert all(now[k] == (False, how == "close") for k in untouched)
    assert {s[:3] for s in statuses(result)} == (set() if how == "close" else {("a", "INBOX", 0)})
    assert now.get(("a", "INBOX", 0)) == ((True, False) if how in ("mark", "fetch") else None)


def stopping(spark, bad):
    """Four batches of one message in account a, two in b; some are refused."""
    rows = [message("a", "INBOX", i, body=b"m%d" % i) for i in range(4)]
    rows += [message("b", "INBOX", 10 + i, body=b"m%d" % (10 + i)) for i in range(2)]
    return mailbox(spark, rows)


def test_careful_function_is_not_called_after_a_stop(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.makedirs(log)

    def fn(raw, digest):
        name = raw.rsplit(b"\n", 1)[-1].decode()
        open(os.path.join(log, name), "x").close()
        return name != "m1"

    command = Fetch(target=CallTarget(fn, "fn"), mode="careful", batch_number=1)
    result = run_pipeline(stopping(spark, "m1"), [command], NOW)
    called = sorted(os.listdir(log))
    assert called == ["m0", "m1", "m10", "m11"]
    got = {(s[2], s[3]) for s in statuses(result) if s[2] is not None}
    assert got == {(0, "marked"), (1, "failed"), (2, "not_attempted"), (3, "not_attempted"),
                   (10, "marked"), (11, "marked")}


def test_careful_maildir_shows_nothing_after_a_stop(spark, tmp_path, monkeypatch):
    from lettermill.plans import pipeline

    path = str(tmp_path / "mail")
    real = pipeline.write_tmp_files

    def failing(clean, where, host=None):
        """The second message cannot be written."""
        written = real(clean, where, host)
        lost = F.col("uid") == 1
        return written.withColumn("tmp_name", F.when(~lost, F.col("tmp_name"))).withColumn(
            "detail", F.when(lost, F.lit("disk full")).otherwise(F.col("detail")))

    monkeypatch.setattr(pipeline, "write_tmp_files", failing)
    command = Fetch(target=MaildirTarget(path, "host"), mode="careful", batch_number=1)
    result = run_pipeline(stopping(spark, "m1"), [command], NOW)
    assert len(os.listdir(os.path.join(path, "new"))) == 3  # 0, 10 and 11
    assert seen(result) == [("a", "INBOX", 0), ("b", "INBOX", 10), ("b", "INBOX", 11)]
    got = {s[2]: s[3] for s in statuses(result) if s[2] is not None}
    assert got == {0: "marked", 1: "failed", 2: "not_attempted", 3: "not_attempted", 10: "marked", 11: "marked"}


def test_messages_without_size_are_conflicts(spark, tmp_path):
    rows = [message("a", "INBOX", 1), message("a", "INBOX", 2, size=None), message("b", "INBOX", 3)]
    result = run_pipeline(
        mailbox(spark, rows), [Fetch(target=TableTarget(str(tmp_path / "x"))), Delete(folders=ALL)], NOW)
    assert ("a", "INBOX", 2, "conflict") in statuses(result)
    assert keys(result.messages) == [("a", "INBOX", 1), ("a", "INBOX", 2)]
    assert seen(result) == [("a", "INBOX", 1)]


def test_state_changes_leave_inline_content_where_it_lies(spark, tmp_path):
    """No table of the state has content, and no shuffle of a later fetch; the result still has it."""
    rows = [message("a", "INBOX", i, OLD if i < 3 else NEW, body=b"m%d" % i) for i in range(6)]
    rows += [message("b", "INBOX", 9, OLD, seen=True, body=b"same"), message("b", "INBOX", 9, OLD, seen=True, body=b"same")]
    box = mailbox(spark, rows, accounts=(("a", "imap.gmail.com"), ("b", "imap.example.com")))
    root = work_dir(spark).removeprefix("file:") + "/lettermill"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    target = TableTarget(str(tmp_path / "archive"), "host")
    result = run_pipeline(box, [
        Fetch(target=target, filter=MessageFilter(seen=False, older_than_days=(7,))),
        Fetch(target=target),
        Delete(filter=MessageFilter(older_than_days=(7,)), folders=FolderChoice(("INBOX",)), method="gmail-trash"),
        Fetch(target=target, filter=MessageFilter(seen=True), mark="noop", folders=FolderChoice(("[Gmail]/Trash",))),
    ], NOW)
    assert result.messages.columns == box.messages.columns
    found = sorted((r.account, r.folder, r.uid, bytes(r.body)) for r in result.messages.collect())
    trash = "[Gmail]/Trash"
    assert found == [("a", "INBOX", i, b"m%d" % i) for i in range(3, 6)] + [
        ("a", trash, i + 1, b"m%d" % i) for i in range(3)] + [("b", trash, i, b"same") for i in (1, 2)]
    index = read_archive_index(spark, target.path)
    assert sorted(index.filter("part = '0'").toPandas()["uid"]) == [0, 1, 2]
    assert sorted(index.filter("part = '1'").toPandas()["uid"]) == [3, 4, 5]
    archived = read_archive_table(spark, target.path).filter((F.col("folder") == trash) & (F.col("account") == "a"))
    assert sorted((r.uid, bytes(r.body)) for r in archived.collect()) == [(i + 1, b"m%d" % i) for i in range(3)]
    made = [n for n in os.listdir(root) if n not in before]
    assert made and not any({"header", "body"} & set(spark.read.parquet(f"file:{root}/{n}").columns) for n in made)


def test_only_turns_that_come_are_read(spark):
    """Content is asked for by waves; what is handed over is as if it had all been there."""
    rows = spark.createDataFrame(
        [(0, "a", 0, "f", n // 2, n) for n in range(40)] + [(1, "b", 0, "f", n // 2, n) for n in range(40)],
        "account_idx int, account string, folder_idx int, folder string, batch_id bigint, uid bigint")
    content = dlv.clean_content(rows.select(
        "account", "folder", "uid", F.lit("h").alias("header"), F.concat("account", F.lit(" "), "uid").alias("body")))
    asked = []

    def content_of(keys):
        asked.append(keys.count())
        return content.join(keys, ["account", "folder", "uid"], "left_semi")

    def fn(raw, _):
        return raw not in (b"ha 2", b"ha 3")

    whole = dlv.deliver_in_turn(rows.join(content, ["account", "folder", "uid"]), fn, "careful", 2)
    waves = dlv.deliver_in_turn(rows, fn, "careful", 2, content_of=content_of)
    assert sorted(map(tuple, waves.collect())) == sorted(map(tuple, whole.collect()))
    assert asked == [8, 36] and waves.count() == 4 + 40
