"""Content is neither dealt out nor written more often than a query has to."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from boxes import NOW, mailbox, message
from checks import flows
from checks import mailbox as mb
from lettermill.operators.ranking import duplicate_number
from lettermill.plans import pipeline
from lettermill.plans.commands import Fetch, TableTarget
from lettermill.session import work_dir
from lettermill.sources import archive_table as at
from lettermill.sources import maildir as md
from lettermill.sources import store as store_module
from lettermill.sources.store import Store
from lettermill.streaming.cycles import run_cycle


@pytest.fixture
def tables(spark, tmp_path):
    events = [(i, dt.datetime(2024, 1, 1 + i % 9), i % 7, ("click", "view", "error")[i % 3], 1.5 * i, f'{{"k": {i}}}')
              for i in range(60)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                  "value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    documents = [(i, f"text {i % 4}\nline", "en", "web", 11) for i in range(6)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def exchanges(df):
    """Lines of exchanges in the plan, with what they deal out."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [part for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]


def written(spark, label):
    root = work_dir(spark).removeprefix("file:") + "/lettermill"
    return {n for n in os.listdir(root) if n.startswith(label)} if os.path.isdir(root) else set()


def test_digests_of_the_archive_go_without_content(spark, tables):
    clean = flows._clean(spark, tables)
    path = f"{tables}/archive"
    stored = at.write_archive_content(clean, path, 0)
    rows = stored.join(mb.messages(spark, tables).select(*flows._ORDER), ["account", "folder", "uid"])
    at.write_archive_index(md.add_names(duplicate_number(rows), "host"), path, 0)
    back = at.read_archive_table(spark, path, body_hash=F.sha2("body", 256), n=F.octet_length("header"))
    joined = back.hint("merge")
    assert not any("body#" in e or "header#" in e for e in exchanges(joined))
    want = at.read_archive_table(spark, path).select("uid", F.sha2("body", 256), F.octet_length("header"))
    got = back.select("uid", "body_hash", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60


def test_hashes_are_taken_once(spark, tables):
    before = written(spark, "hashes")
    got = {(r.uid, r.dup_no) for r in flows.duplicates_continue(spark, tables).collect()}
    assert len(written(spark, "hashes") - before) == 1 and len(got) == 30


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_numbers_of_rows_without_hash(spark, hot):
    rows = spark.createDataFrame(
        [(0, 0, i, None if i % 3 == 0 else f"h{i % 3}") for i in range(12)],
        "account_idx int, folder_idx int, uid long, msg_hash string")
    got = duplicate_number(rows, hot=hot).collect()
    assert sorted((r.uid, r.dup_no) for r in got) == [(i, i // 3) for i in range(12)]


def test_names_go_to_content(spark, tables, monkeypatch):
    asked = []
    whole = md.write_maildir
    monkeypatch.setattr(md, "write_maildir", lambda named, path: (asked.append(named), whole(named, path)))
    monkeypatch.setattr(mb, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").hint("merge"))
    got = flows.maildir_sink(spark, tables)
    assert got.filter(~F.col("name").contains(F.col("msg_hash"))).count() == 0
    assert got.select("name").distinct().count() == 60
    # text is dealt out by document, before it is any message's content
    assert not any("body#" in e and "uid#" in e for e in exchanges(asked[0]))


def test_stored_content_is_read_in_passes(spark, tmp_path, monkeypatch):
    rows = [message("a", "INBOX", i, body=b"m%d" % i) for i in range(9)]
    whole = mailbox(spark, rows)
    contents = whole.messages.select("account", "origin_folder", "origin_uid", "header", "body")
    box = pipeline.Mailbox(whole.accounts, whole.folders, whole.messages.drop("header", "body"), contents)
    monkeypatch.setattr(pipeline, "_HASHED_KEYS", 2)
    before = written(spark, "keys")
    target = TableTarget(str(tmp_path / "archive"))
    pipeline.run_pipeline(box, [Fetch(target=target)], NOW)
    got = at.read_archive_table(spark, target.path).collect()
    assert sorted((r.uid, bytes(r.body)) for r in got) == [(i, b"m%d" % i) for i in range(9)]
    assert len(written(spark, "keys") - before) == 1


def test_stored_content_is_compressed(spark, tmp_path):
    box = mailbox(spark, [message("a", "INBOX", 1)])
    store = Store.create(spark, f"file:{tmp_path}/store", box.accounts, box.folders, buckets=2)
    store.add_arrivals(0, box.messages.drop("header", "body"), box.messages.select(
        "account", "origin_folder", "origin_uid", "header", "body"), "mail")
    files = [n for _, _, names in os.walk(tmp_path / "store" / "contents") for n in names if n.endswith(".parquet")]
    assert files and all(".zstd." in n for n in files)


def test_stored_content_is_written_where_it_was_read(spark, tmp_path):
    """Neither dealt out nor sorted: each task writes what it has into files of the buckets."""
    box = mailbox(spark, [message("a", "INBOX", i, body=b"m%d" % i) for i in range(40)])
    store = Store.create(spark, f"file:{tmp_path}/store", box.accounts, box.folders, buckets=2)
    rows = box.messages.repartition(3, "uid")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    store.add_arrivals(0, rows.drop("header", "body"), rows.select(
        "account", "origin_folder", "origin_uid", "header", "body"), "mail")
    files = [n for _, _, names in os.walk(tmp_path / "store" / "contents") for n in names if n.endswith(".parquet")]
    assert {n.split("-")[1] for n in files} == {"00000", "00001", "00002"} and spark.conf.get(name) == before
    loaded = store.load()[0]
    address = ["account", "origin_folder", "origin_uid", "origin_batch"]
    whole = loaded.messages.join(loaded.contents.hint("merge"), address)
    assert not any("body#" in e for e in exchanges(whole))
    assert sorted((r.uid, bytes(r.body)) for r in whole.collect()) == [(i, b"m%d" % i) for i in range(40)]


def test_many_buckets_are_not_open_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "_OPEN_BUCKETS", 2)
    box = mailbox(spark, [message("a", "INBOX", i, body=b"m%d" % i) for i in range(40)])
    store = Store.create(spark, f"file:{tmp_path}/store", box.accounts, box.folders, buckets=5)
    store.add_arrivals(0, box.messages.drop("header", "body"), box.messages.select(
        "account", "origin_folder", "origin_uid", "header", "body"), "mail")
    files = [n for _, _, names in os.walk(tmp_path / "store" / "contents") for n in names if n.endswith(".parquet")]
    assert len(files) == 5 and store.load()[0].contents.count() == 40


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle")}


def test_shuffles_of_a_cycle_do_not_stay(spark, tmp_path):
    box = mailbox(spark, [message("a", "INBOX", i, body=b"m%d" % i) for i in range(9)])
    store = Store.create(spark, f"file:{tmp_path}/store", box.accounts, box.folders, buckets=2)
    rows = box.messages.repartition(3, "uid")
    before, spark_setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    store.add_arrivals(0, rows.drop("header", "body"), rows.select(
        "account", "origin_folder", "origin_uid", "header", "body"), "mail")
    arrived = shuffle_files(spark) - before
    run_cycle(store, [Fetch(target=TableTarget(str(tmp_path / "archive")))], 0, NOW, "clock")
    left = shuffle_files(spark) - before - arrived
    assert len({n.split("_")[1] for n in left}) <= 8 and len({n.split("_")[1] for n in arrived}) <= 3
    assert spark.conf.get(spark_setting) == "false" and store.messages().filter("not seen").count() == 0


def test_names_go_once_to_documents_that_come_twice(spark, tables):
    place = f"{tables}/twice"
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    documents.unionByName(documents.filter("doc_id = 2")).write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{tables}/events.parquet").write.parquet(f"{place}/events.parquet")
    got = flows.maildir_sink(spark, place)
    assert got.count() == got.select("name").distinct().count() == flows._hashed(spark, place).count() > 50
    assert got.filter(~F.col("name").contains(F.col("msg_hash"))).count() == 0
