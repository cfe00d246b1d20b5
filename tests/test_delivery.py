from pyspark.sql import functions as F

from boxes import keys, mailbox, message
from lettermill.operators import delivery as dlv
from lettermill.operators import transitions as tr
from lettermill.operators.filters import MessageFilter
from lettermill.operators.safety import isolate_failures
from lettermill.plans.recipes import oldest_copies, reconcile_archives

_ROWS = [(1, 1, True), (2, 1, True), (3, 2, False), (4, 2, True), (5, 3, False), (6, 3, False),
         (7, 4, True)]
_SCHEMA = ("account_idx int, account string, command_idx int, folder_idx int, folder string, "
           "uid bigint, batch_id bigint, ok boolean")


def statuses(spark, mode, rows=None, **kw):
    rows = rows or [(0, "a", 0, 0, "f", u, b, ok) for u, b, ok in _ROWS]
    df = dlv.delivery_outcome(spark.createDataFrame(rows, _SCHEMA), mode, **kw)
    return {r.uid: r.status for r in df.collect()}


def test_delivery_modes(spark):
    yolo = {1: "marked", 2: "marked", 3: "failed", 4: "marked", 5: "failed", 6: "failed",
            7: "marked"}
    assert statuses(spark, "yolo") == yolo
    assert statuses(spark, "careful") == {**yolo, 7: "not_attempted"}
    assert statuses(spark, "paranoid") == {
        **yolo, 4: "delivered_unmarked", 5: "not_attempted", 6: "not_attempted",
        7: "not_attempted"}
    assert statuses(spark, "yolo", marking=False)[1] == "delivered"


def test_stop_scopes(spark):
    """An empty batch ends its account, a partial one (paranoid) the whole run."""
    rows = [
        (0, "a", 0, 0, "f", 1, 0, False), (0, "a", 0, 1, "g", 2, 0, True),
        (1, "b", 0, 0, "f", 3, 0, True), (1, "b", 0, 1, "g", 4, 0, False),
        (1, "b", 0, 1, "g", 5, 0, True), (1, "b", 0, 2, "h", 6, 0, True),
        (2, "c", 0, 0, "f", 7, 0, None),
    ]
    assert statuses(spark, "careful", rows) == {
        1: "failed", 2: "not_attempted", 3: "marked", 4: "failed", 5: "marked", 6: "marked",
        7: "conflict"}
    assert statuses(spark, "paranoid", rows) == {
        1: "failed", 2: "not_attempted", 3: "marked", 4: "failed", 5: "delivered_unmarked",
        6: "not_attempted", 7: "not_attempted"}
    judged = dlv.judge_batches(dlv.batch_summary(spark.createDataFrame(rows, _SCHEMA)), "careful")
    assert sorted((r.account, r.detail) for r in dlv.delivery_errors(judged, "x").collect()) == [
        ("a", "1 message not delivered to `x`"), ("a", dlv.ABORTED),
        ("b", "1 message not delivered to `x`")]


def test_deliver_isolates_failures(spark):
    def fn(raw, digest):
        assert len(digest) == 64
        if raw.endswith(b"boom"):
            raise RuntimeError("boom")
        return {b"one": 1, b"no": False}.get(raw[-3:].strip(), 0)

    rows = [message("a", "f", i, body=b) for i, b in enumerate([b"fine", b"boom", b"one", b" no"])]
    clean = dlv.clean_content(mailbox(spark, rows).messages)
    got = {r.uid: (r.ok, r.detail) for r in dlv.deliver(clean, fn).collect()}
    assert {u: ok for u, (ok, _) in got.items()} == {0: True, 1: False, 2: False, 3: False}
    assert got[1][1] == "RuntimeError: boom"


def test_missing_and_conflicts(spark):
    asked = spark.createDataFrame(
        [("a", "f", u, u // 3) for u in range(7)], "account string, folder string, uid bigint, chunk bigint")
    lost, errors = dlv.missing_responses(asked, asked.filter("uid <> 4"))
    assert [k[2] for k in keys(lost)] == [3, 4, 5] and errors.count() == 1
    good, bad = dlv.conflicts(asked.withColumn("chunk", F.when(F.col("uid") != 2, F.col("chunk"))),
                              ["uid", "chunk"])
    assert good.count() == 6 and [r.uid for r in bad.collect()] == [2]


def test_marking_twice_changes_nothing(spark):
    m = mailbox(spark, [message("a", "f", i, seen=i % 2 == 0) for i in range(6)]).messages
    c = MessageFilter(seen=False).column()
    once = tr.mark(m, c, "seen")
    assert once.filter("seen").count() == 6
    twice = tr.mark(once, F.lit(True), "seen")
    assert sorted(once.collect()) == sorted(twice.collect())
    by_key = tr.mark_by_key(m, m.filter("uid in (1, 2)").select("account", "folder", "uid"), "flagged")
    assert [k[2] for k in keys(by_key.filter("flagged"))] == [1, 2]


def test_expunge_takes_stale_mail_in_touched_folders(spark):
    m = mailbox(spark, [
        message("a", "f", 1, seen=True), message("a", "f", 2, deleted=True), message("a", "f", 3),
        message("a", "g", 4, deleted=True), message("b", "f", 5, deleted=True),
    ]).messages
    left = tr.delete(m, F.col("seen"), "delete")
    assert keys(left) == [("a", "f", 3), ("a", "g", 4), ("b", "f", 5)]
    kept = tr.delete(m, F.col("seen"), "delete-noexpunge")
    assert kept.filter("deleted").count() == 4
    assert keys(tr.close_folder(kept, F.col("folder") == "f")) == [("a", "f", 3), ("a", "g", 4)]


def test_trash_gets_new_uids(spark):
    m = mailbox(spark, [
        message("a", "f", 9, seen=True), message("a", "e", 5, seen=True),
        message("a", "[Gmail]/Trash", 7, seen=True), message("b", "f", 3, seen=True),
    ]).messages
    after = tr.delete(m, F.col("seen"), "gmail-trash")
    got = {(r.account, r.folder, r.uid): (r.origin_folder, r.labels) for r in after.collect()}
    assert got == {
        ("a", "[Gmail]/Trash", 7): ("[Gmail]/Trash", ["\\Trash"]),
        ("a", "[Gmail]/Trash", 8): ("e", ["\\Trash"]),
        ("a", "[Gmail]/Trash", 9): ("f", ["\\Trash"]),
        ("b", "[Gmail]/Trash", 1): ("f", ["\\Trash"]),
    }


def test_isolate_failures(spark):
    units = spark.createDataFrame(
        [(a, "abc"[a], c, f) for a in range(3) for c in range(2) for f in range(2)],
        "account_idx int, account string, command_idx int, folder_idx int")
    failures = spark.createDataFrame(
        [("a", 0, 0, "folder"), ("b", 0, 1, "account"), ("c", 1, 0, "run")],
        "account string, command_idx int, folder_idx int, kind string")
    got = {(r.account, r.command_idx, r.folder_idx): r.status
           for r in isolate_failures(units, failures).collect() if r.status != "ok"}
    assert got == {("a", 0, 0): "failed", ("b", 0, 1): "failed", ("b", 1, 0): "skipped",
                   ("b", 1, 1): "skipped", ("c", 1, 0): "failed", ("c", 1, 1): "skipped"}


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "msg_hash string, uid bigint")
    b = spark.createDataFrame([("x", 9), ("z", 8)], "msg_hash string, uid bigint")
    got = {r.msg_hash: (r.copies_a, r.copies_b, r.side) for r in reconcile_archives(a, b).collect()}
    assert got == {"x": (2, 1, "both"), "y": (1, 0, "only_a"), "z": (0, 1, "only_b")}
    assert {(r.msg_hash, r.uid) for r in oldest_copies(a, ["uid"]).collect()} == {("x", 1), ("y", 3)}


def _calls(path):
    return sorted(open(path, encoding="utf-8").read().split()) if path.exists() else []


def test_waves_stop_where_one_task_after_another_would(spark, tmp_path):
    """One account has nine tenths of the rows; it is delivered by many tasks, and nothing is
    handed over after a stop, in the account (careful) or in the run (paranoid)."""
    rows = [(0, "big", 0, "INBOX", k // 3, k, k) for k in range(90)]
    rows += [(1, "small", 0, "INBOX", k // 3, k, 1000 + k) for k in range(9)]
    table = spark.createDataFrame(
        rows, "account_idx int, account string, folder_idx int, folder string, batch_id bigint, uid bigint, n long")
    table = table.select("*", F.lit("").alias("header"), F.col("n").cast("string").alias("body"),
                         F.col("n").cast("string").alias("msg_hash"))

    def refusing(bad, log):
        def fn(raw, digest):
            with open(log, "a", encoding="utf-8") as out:
                out.write(f"{int(raw)}\n")
            return int(raw) not in bad
        return fn

    whole, part = {30, 31, 32}, {31}  # batch 10 of the large account
    for mode, bad, called in (
        ("careful", whole, 33 + 9), ("careful", part, 99), ("paranoid", whole, 33 + 9), ("paranoid", part, 33),
    ):
        log = tmp_path / f"{mode}-{len(bad)}"
        got = dlv.deliver_in_turn(table, refusing(bad, log), mode, run_batches=4).collect()
        assert len(_calls(log)) == len(got) == called
        assert {(r.account, r.uid) for r in got if not r.ok} == {("big", b) for b in bad}
    assert dlv.deliver_in_turn(table.limit(0), lambda raw, digest: 0, "careful").count() == 0
