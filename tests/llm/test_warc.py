import base64
import glob
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lettermill.llm.merging import LoserTree
from lettermill.llm.warc import (
    capture_histories,
    merge_runs,
    read_archives,
    read_index,
    read_record,
    round_trip,
    url_key,
    write_archives,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, at long, digest string, row int, payload string, captured int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, t, "d", 1, "p", 2) for i, u, h, t in rows], SCHEMA)


def at():
    return F.timestamp_seconds("at")


def plain(rows, least=0):
    """What a page must become, one payload after another."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = {}, []
    for k in order:
        i, _, html, _ = rows[k]
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = seen.setdefault(digest, i) if digest in seen or len(body) < least else None
        again = digest in seen and len(body) >= least
        if len(body) >= least:
            seen.setdefault(digest, i)
        out.append((i, len(body), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def digest_rows(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()),
                  key=str)


ODD = [
    (1, "http://www.b.example/x?b=2&a=1#top", "<p>one</p>", 50), (2, "https://b.example:443/x?a=1&b=2", "<p>one</p>", 40),
    (3, None, None, None), (4, "not a url %\r\nX: y", "", 7), (None, "http://a.example/", "<p>one</p>", 9),
    (None, "http://a.example/", "only without an id", 9), (5, "http://a.example", "Ünïcode 😀\r\n\r\nWARC/1.1", -10**9),
    (6, "http://c.example/ü ü", "same row", 3), (6, "http://c.example/ü ü", "same row", 3), (-7, "http://user@C.Example:8080/", "x", 1),
    (8, "", "long " * 300_000, 5), (9, "http://c.example/%7E", "long " * 300_000, 5),
]


def test_odd_pages(spark):
    assert digest_rows(round_trip(pages(spark, ODD), at())) == plain(ODD)


def test_small_payloads_are_all_responses(spark):
    got = digest_rows(round_trip(pages(spark, ODD), at(), 9))
    assert got == plain(ODD, 9) and sum(r[3] == "revisit" for r in got) == 3


def test_no_pages(spark):
    assert round_trip(pages(spark, []), at()).count() == 0


def test_text_ids_and_other_names(spark):
    rows = pages(spark, ODD).select(F.concat(F.lit("p %"), "page_id").alias("key"), F.col("url").alias("u"),
                                    F.col("html").alias("h"), "at")
    got = round_trip(rows, at(), page_id="key", url="u", html="h").collect()
    assert {r.page_id for r in got} == {None if i is None else f"p %{i}" for i, *_ in ODD}
    assert {r.url for r in got} == {u for _, u, _, _ in ODD}


def test_query_agrees_with_plain_version(spark):
    rows = [(r.page_id, r.url, r.html, 0) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert digest_rows(entry.queries()["op13_warc"](spark, SF)) == plain(rows)


def test_index_is_in_global_order_and_finds_records(spark, tmp_path):
    rng = random.Random(5)
    urls = ["http://hot.example/"] * 300 + [f"http://h{rng.randint(0, 30)}.example/{k}" for k in range(300)]
    rows = [(k, u, f"<p>{k % 250}</p>", rng.randint(0, 99)) for k, u in enumerate(urls)]
    table = pages(spark, rows).repartition(7)
    runs = write_archives(table, str(tmp_path), at(), archive_bytes=20_000, run_captures=13)
    assert runs.groupBy("run").count().where("count > 13").isEmpty()
    index = merge_runs(runs, str(tmp_path), 50)
    got = index.orderBy("place").collect()
    assert [r.place for r in got] == list(range(600))
    keys = [(r.url_key.encode(), r.captured, r.row) for r in got]
    assert keys == sorted(keys) and {int(r.page_id) for r in got} == set(range(600))
    assert read_index(spark, str(tmp_path)).count() == 600
    histories = capture_histories(index).where("url_key = 'example,hot)/'").orderBy("capture").collect()
    assert [r.capture for r in histories] == list(range(300)) and {r.captures for r in histories} == {300}
    assert [r.captured for r in histories] == sorted(t * 10**6 for _, u, _, t in rows[:300])

    by_file = {}
    for r in got:
        by_file.setdefault(r.file, []).append(r)
    assert set(by_file) == {p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/*.warc.gz")} and len(by_file) > 7
    for name, found in by_file.items():  # a plain reader of gzip files sees the same records
        data, records = (tmp_path / name).read_bytes(), 0
        while data:
            opener = zlib.decompressobj(31)
            assert opener.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
            data, records = opener.unused_data, records + 1
        assert records == len(found)
    read = read_archives(index, str(tmp_path))
    assert digest_rows(read) == plain(rows) and read.rdd.getNumPartitions() == len(by_file)


def test_damage_is_found(spark, tmp_path):
    index = merge_runs(write_archives(pages(spark, ODD[:1]), str(tmp_path), at()), str(tmp_path))
    entry_ = index.first()
    data = (tmp_path / entry_.file).read_bytes()[entry_.at : entry_.at + entry_.length]
    found = read_record(data)
    assert found["block"].endswith(b"\r\n\r\n<p>one</p>") and found["WARC-Target-URI"] == ODD[0][1]
    raw = zlib.decompress(data, 31).replace(b"<p>one", b"<p>two")
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    for bad in (packer.compress(raw) + packer.flush(), data[:-3], data + data):
        with pytest.raises(ValueError):
            read_record(bad)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 40))) for _ in range(k)]
    got = list(LoserTree([iter(r) for r in runs]))
    assert got == sorted(((n, x) for n, r in enumerate(runs) for x in r), key=lambda p: (p[1], p[0]))
    with pytest.raises(ValueError):
        list(LoserTree([iter([2, 1]), *map(iter, runs)]))


def test_url_keys():
    assert url_key("http://www.b.example/x?b=2&a=1#top") == url_key("https://b.example:443/x?a=1&b=2") == "example,b)/x?a=1&b=2"
    assert url_key("HTTP://a.example") == "example,a)/" and url_key(None) == "" and url_key("mailto:X@y") == "mailto:x@y"
    assert url_key("http://user@C.Example:8080/Q") == "example,c:8080)/q"
