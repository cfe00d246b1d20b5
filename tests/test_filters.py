import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from boxes import NEW, NOW, OLD, mailbox, message
from lettermill.operators.filters import MessageFilter, default_filter, resolve_mark_auto, to_ns
from lettermill.operators.folders import FolderChoice, list_folders, select_folders
from lettermill.plans.commands import Delete, Fetch, Mark, TableTarget, describe, prepare
from lettermill.schema import FOLDERS


def test_rendered_text():
    assert MessageFilter().bind(NOW).render() == "(ALL)"
    assert MessageFilter().bind(NOW).render(True) == "(ALL)"
    assert default_filter("fetch", MessageFilter()).bind(NOW).render() == "(UNSEEN)"
    full = MessageFilter(seen=False, flagged=True, from_contains=('a"b',), from_not_contains=("c\\d",),
                         older_than_days=(1,), newer_than_days=(5,))
    assert full.bind(NOW).render(True) == (
        '(UNSEEN FLAGGED FROM "a\\"b" NOT FROM "c\\\\d" BEFORE 30-Jan-2024'
        " NOT BEFORE 26-Jan-2024) {dynamic}"
    )


def test_cutoffs_earliest_older_latest_newer():
    f = MessageFilter(older_than_days=(1, 9, 3), newer_than_days=(1, 9, -2))
    bound = f.bind(dt.datetime(2024, 1, 31, 23, 59))
    assert bound.before == dt.date(2024, 1, 22)
    assert bound.not_before == dt.date(2024, 2, 2)
    assert MessageFilter(older_than_days=(0,)).bind(NOW).before == dt.date(2024, 1, 31)
    assert MessageFilter(older_than_days=(1,)).bind(-1).before == dt.date(1969, 12, 30)


def test_stamp_files(spark, tmp_path):
    zero, half, bad = tmp_path / "zero", tmp_path / "half", tmp_path / "bad"
    zero.write_text("0\n")
    half.write_text("  1706000000.5 \nsecond line is not read\n")
    bad.write_text("yesterday\n1\n")
    f = MessageFilter(older_than_days=(7,), older_than_timestamp_in=(str(zero), str(half)))
    assert f.bind(NOW, spark).render(True) == "(BEFORE 1-Jan-1970) {dynamic}"
    g = MessageFilter(newer_than_timestamp_in=(str(half),))
    assert g.bind(NOW, spark).not_before == dt.date(2024, 1, 23)
    with pytest.raises(Exception, match="failed to decode a timestamp.*bad"):
        MessageFilter(older_than_timestamp_in=(str(bad),)).bind(NOW, spark)


def test_file_age(spark, tmp_path):
    stamp = tmp_path / "stamp"
    stamp.write_text("")
    os.utime(stamp, (1706000000, 1706000000))
    f = MessageFilter(older_than_mtime_of=(str(stamp),), newer_than_mtime_of=(str(stamp),))
    bound = f.bind(NOW, spark)
    assert (bound.before, bound.not_before) == (dt.date(2024, 1, 23),) * 2


def test_sender_is_literal_and_any_case(spark):
    rows = spark.createDataFrame([("A_b%C",), ("axbyc",), (None,)], "from_addr string")
    hit = rows.filter(MessageFilter(from_contains=("_B%",)).column())
    assert [r[0] for r in hit.collect()] == ["A_b%C"]
    miss = rows.filter(MessageFilter(from_not_contains=("_b%",)).column())
    assert {r[0] for r in miss.collect()} == {"axbyc", None}


def test_complement(spark):
    rows = [message("a", "INBOX", i, OLD if i % 3 else NEW, seen=i % 2 == 0, flagged=i % 5 == 0)
            for i in range(60)]
    m = mailbox(spark, rows).messages
    c = MessageFilter(seen=True, flagged=False, newer_than_days=(7,)).column(NOW)
    assert m.filter(c).count() + m.filter(~c).count() == 60


def test_defaults():
    assert default_filter("count", MessageFilter()) == MessageFilter()
    assert default_filter("fetch", MessageFilter(seen=None)).seen is None
    assert default_filter("fetch", MessageFilter(flagged=False)).seen is False
    assert default_filter("delete", MessageFilter()).seen is True
    assert default_filter("mark", MessageFilter(), "unflagged").flagged is True
    assert default_filter("mark", MessageFilter(), "seen").seen is False
    assert default_filter("mark", MessageFilter(flagged=True), "seen") == MessageFilter(flagged=True)


def test_mark_auto():
    assert resolve_mark_auto(MessageFilter(seen=False)) == "seen"
    assert resolve_mark_auto(MessageFilter(seen=None, flagged=False)) == "flagged"
    assert resolve_mark_auto(MessageFilter(seen=False, flagged=False)) == "noop"
    assert Fetch(filter=MessageFilter(flagged=False)).mark_name() == "noop"
    assert Fetch().mark_name() == "seen"


def test_describe():
    stamped = MessageFilter(older_than_days=(20000,))
    target = TableTarget("/x")
    commands = [
        Fetch(target=target, folders=FolderChoice(("[Gmail]/All Mail",))), None,
        Delete(filter=stamped, folders=FolderChoice(("[Gmail]/All Mail", "[Gmail]/Spam"), ("X",))),
    ]
    now = to_ns(dt.datetime(2024, 10, 4))
    assert describe(commands, [("account@gmail.com", "imap.gmail.com", 993)], now, 3600) == [
        "# every 3600 seconds, for each of",
        "... user account@gmail.com on host imap.gmail.com port 993 (SSL)",
        "# do",
        "... in '[Gmail]/All Mail': search (UNSEEN), perform fetch, mark them as SEEN",
        "... in '[Gmail]/All Mail', '[Gmail]/Spam' excluding 'X': search (SEEN BEFORE 1-Jan-1970)"
        " {dynamic}, perform delete",
    ]


def test_commands_are_checked():
    with pytest.raises(ValueError, match="folders"):
        prepare([Mark(how="seen")])
    with pytest.raises(ValueError, match="target"):
        prepare([Fetch()])
    assert prepare([None, Mark(how="seen")], FolderChoice(("INBOX",)))[0].folders.include == ("INBOX",)


def test_folders(spark):
    rows = [(0, "a", 0, "INBOX", "/", []), (0, "a", 1, "[Gmail]", "/", ["\\Noselect"]),
            (0, "a", 2, "Lists", "/", ["\\Trash"]), (1, "b", 0, "Lists", "/", [])]
    folders = spark.createDataFrame(rows, FOLDERS)
    assert [(r.account, r.folder) for r in list_folders(folders).collect()] == [
        ("a", "INBOX"), ("a", "Lists"), ("b", "Lists")]
    visited, unknown = select_folders(folders, ("Lists", "INBOX", "[Gmail]"), ("Nothing",))
    assert [(r.account, r.folder) for r in visited.orderBy("account_idx", "folder_idx").collect()] == [
        ("a", "Lists"), ("a", "INBOX"), ("b", "Lists")]
    assert {(r.account, r.folder) for r in unknown.collect()} == {
        ("a", "[Gmail]"), ("b", "INBOX"), ("b", "[Gmail]")}
    everything, none = select_folders(folders, exclude=("Lists",))
    assert [r.folder for r in everything.collect()] == ["INBOX"] and none.count() == 0
