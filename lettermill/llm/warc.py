"""Web pages in WARC files, with a capture index merged from sorted runs.

Writing tasks put one record per page into compressed archives, each record a gzip member of
its own.  Of equal payloads, the one with the smallest page id is a ``response``; the others
are ``revisit`` records that name it and hold no payload.  While it writes, a task collects
its captures, sorts them by URL key and time, and hands them over as a run; no run has more
than a fixed number of captures.

The index over all archives is an external merge of these runs.  Captures are dealt out by
ranges of (URL key, time, row), so that even one URL with very many captures is divided;
the task of a range puts the slices of the runs together again and merges them with a tree
of losers.  The merged index is in global order: it holds the history of each URL, and it
says in which file and where each record is.  Archives are read through it.

Tasks write to a folder that all executors share.  A task that is run again writes files of
other names; only files in the runs, which Spark commits, count.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.llm.folders import open_folder
from lettermill.llm.merging import LoserTree
from lettermill.session import attach, materialise, scratch_path, ship_package

ARCHIVE_BYTES = 1 << 30
RUN_CAPTURES = 50_000
RANGE_CAPTURES = 32_768
_LEVEL = 4
# fixed values of the format
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PORTS = {"http": "80", "https": "443"}
_DIGEST_TEXT = re.compile("[A-Z2-7]{32}")
_ENTRY = ("run string, pos int, url_key string, captured long, row long, page_id string, kind string, file string, "
          "at long, length long")


def url_key(url: str | None) -> str:
    """The name that a URL's captures are sorted by: host labels from the last to the first, then
    path and sorted arguments, all without scheme, user, ``www``, default port and fragment.

    What has no host is its own key in lower case; a null URL has the empty key.
    """
    if url is None:
        return ""
    scheme, mark, rest = url.strip().partition("#")[0].partition("://")
    if not mark:
        return scheme.lower()
    cut = re.search("[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = host.split(".")
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    path, mark, arguments = path.partition("?")
    if mark:
        mark += "&".join(sorted(arguments.split("&")))
    port = f":{port}" if port and port != _PORTS.get(scheme.lower()) else ""
    return f"{','.join(reversed(labels))}{port}){path or '/'}{mark}".lower()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _time(micros: int) -> str:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).isoformat(timespec="microseconds") + "Z"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One compressed record; fields that are None are left out."""
    lines = [_VERSION, *(f"{name}: {value}".encode() for name, value in fields if value is not None)]
    raw = b"\r\n".join([*lines, b"", block + b"\r\n\r\n"])
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)  # 31: with a gzip head
    return packer.compress(raw) + packer.flush()


def _name(token: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{token}/{row}')}>"


def _safe(text: str | None) -> str | None:
    """As a header value: control characters, white space and % are escaped."""
    return None if text is None else quote(text, safe="!#$&'()*+,/:;=?@[]~\"<>\\^`{|}-._")


def page_record(token: str, page: dict) -> bytes:
    """The record of a page, which names its response in ``first_row`` if it is a revisit."""
    payload = page["payload"]
    head, digest = _HTTP.format(len(payload)).encode(), base64.b32encode(bytes.fromhex(page["digest"])).decode()
    again = page["first_row"] is not None
    block = head if again else head + payload
    about = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", _name(token, page["row"])),
        ("WARC-Date", _time(page["captured"])),
        ("WARC-Target-URI", _safe(page["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if again:
        about += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _name(token, page["first_row"])),
            ("WARC-Refers-To-Target-URI", _safe(page["first_url"])),
            ("WARC-Refers-To-Date", _time(page["first_captured"])),
            ("Refers-To-Source-ID", _safe(page["first_page"])),
        ]
    about += [("Source-ID", _safe(page["page_id"])), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    return _record(about, block)


def read_record(data: bytes) -> dict:
    """Header fields of one compressed record, its ``block`` and, for HTTP blocks, ``payload_bytes``,
    checked against lengths and digests."""
    opener = zlib.decompressobj(31)
    raw = opener.decompress(data) + opener.flush()
    if not opener.eof or opener.unused_data:
        raise ValueError("not one whole compressed record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != _VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if stated != len(payload) or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return {**fields, "block": block, "payload_bytes": stated}


def write_archives(pages: DataFrame, folder: str, captured: Column, least_bytes: int = 0, page_id: str = "page_id",
                   url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES,
                   run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Write one record per row and return the runs of the capture index.

    Of rows whose payloads (``html`` in UTF-8, null: empty) are equal and have at least
    ``least_bytes``, the one with the smallest ``page_id`` is the response; a null id comes
    after all others, and of rows with one id one is chosen.  ``captured`` is a timestamp;
    null counts as 1970.  Null URLs are left out of the record and have the empty key.  Other
    columns are not read.

    Payloads are copied once into the shared folder, with a number for each row.  They are
    shuffled only if the payloads that repeat are too many to be broadcast at their measured
    size; one with very many copies is then divided.
    """
    spark = pages.sparkSession
    ship_package(spark)
    token = uuid.uuid4().hex
    staged = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.unix_micros(captured.cast("timestamp")), F.lit(0)).alias("captured"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    staged = staged.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id())
    staged = materialise(staged, "pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("null"), "page_id", "row", "url", "captured"))
    shared = staged.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        first.alias("f"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    shared = materialise(shared.select(
        "digest", F.col("f.row").alias("first_row"), F.col("f.page_id").cast("string").alias("first_page"),
        F.col("f.url").alias("first_url"), F.col("f.captured").alias("first_captured")), "shared-payloads")
    rows = attach(staged, shared, ["digest"], "left", "row").withColumn("page_id", F.col("page_id").cast("string"))
    again = (F.col("first_row") != F.col("row")) & (F.octet_length("payload") >= least_bytes)
    rows = rows.withColumn("first_row", F.when(again, F.col("first_row")))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, system, root = TaskContext.get().partitionId(), *open_folder(folder)
        stream, name, at, entries = None, "", 0, []

        def run() -> pa.RecordBatch:
            entries.sort(key=lambda e: (e[0].encode(), *e[1:]))
            count = len(entries)
            columns = [[f"{number}-{uuid.uuid4().hex}"] * count, list(range(count)), *map(list, zip(*entries))]
            entries.clear()
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            fields = [f.split() for f in _ENTRY.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)],
                                              [n for n, _ in fields])

        for batch in batches:
            for k in range(batch.num_rows):  # one payload at a time
                page = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if stream is None:
                    system.create_dir(root, recursive=True)
                    name, at = f"{number:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                record = page_record(token, page)
                stream.write(record)
                entries.append((url_key(page["url"]), page["captured"], page["row"], page["page_id"],
                                "response" if page["first_row"] is None else "revisit", name, at, len(record)))
                at += len(record)
                if at >= archive_bytes:
                    stream.close()
                    stream = None
                if len(entries) >= run_captures:
                    yield run()
        if stream is not None:
            stream.close()
        if entries:
            yield run()

    runs = rows.mapInArrow(write, _ENTRY)
    runs.write.parquet(f"{folder}/runs")
    return spark.read.schema(runs.schema).parquet(f"{folder}/runs")


def merge_runs(runs: DataFrame, folder: str, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The captures of all runs in global order of (``url_key``, ``captured``, ``row``), with their
    ``place`` from 0 on; also written to the folder, a file for each range."""
    spark = runs.sparkSession
    order = ["url_key", "captured", "row"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_captures))
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", "pos")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None:
            return
        names, starts, at = held.column("run").to_pylist(), [], None
        for k, name in enumerate(names):
            if name != at:
                starts.append(k)
                at = name
        # bytes of UTF-8 compare like code points, and as Spark compares text
        keys = list(zip(held.column("url_key").cast(pa.binary()).to_pylist(), *(held.column(c).to_pylist() for c in order[1:])))

        def slice_of(start: int, end: int) -> Iterator[tuple]:
            return ((*keys[k], k) for k in range(start, end))

        tree = LoserTree([slice_of(a, b) for a, b in zip(starts, [*starts[1:], len(names)])])
        taken = held.select([c for c in held.schema.names if c not in ("run", "pos")]).take(
            pa.array([key[-1] for _, key in tree], pa.int64()))
        part = pa.array([TaskContext.get().partitionId()] * len(taken), pa.int32())
        taken = taken.append_column("range", part).append_column("nth", pa.array(range(len(taken)), pa.int64()))
        yield from taken.to_batches(max_chunksize=10_000)

    kept = _ENTRY.split(", ", 2)[2]
    dealt.mapInArrow(merge, f"{kept}, range int, nth long").write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The merged index of a folder."""
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = index.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "range").select(
        (F.col("base") + F.col("nth")).alias("place"), *[f.split()[0] for f in _ENTRY.split(", ")[2:]])


def capture_histories(index: DataFrame) -> DataFrame:
    """The index with ``capture`` (place in the history of its URL key, from 0 on) and ``captures``."""
    per = index.groupBy("url_key").agg(F.min("place").alias("first"), F.count("*").alias("captures"))
    found = attach(index, per, ["url_key"], "inner", "place")
    return found.withColumn("capture", F.col("place") - F.col("first")).drop("first")


def read_archives(index: DataFrame, folder: str, page_type: str = "bigint") -> DataFrame:
    """One row per record that the index names, from the archives alone: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Every record is checked against its digests.  A task reads the records of a few archives
    one after another.
    """
    ship_package(index.sparkSession)
    files = max(1, index.select("file").distinct().count())
    dealt = index.select("file", "at", "length", "kind").repartition(files, "file").sortWithinPartitions("file", "at")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        open_name, stream = None, None
        for batch in batches:
            rows = []
            for name, at, length, kind in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length", "kind"))):
                if name != open_name:
                    if stream is not None:
                        stream.close()
                    stream, open_name = system.open_input_file(f"{root}/{name}"), name
                stream.seek(at)
                found = read_record(stream.read(length))
                digest = found["WARC-Payload-Digest"].removeprefix("sha1:")
                if found["WARC-Type"] != kind or not _DIGEST_TEXT.fullmatch(digest):
                    raise ValueError(f"index and archive disagree on {found['WARC-Record-ID']}")
                ids = [found.get(f) for f in ("Source-ID", "WARC-Target-URI", "Refers-To-Source-ID")]
                page, url, refers = (None if i is None else unquote(i) for i in ids)
                rows.append((page, url, found["payload_bytes"], digest, kind, refers))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "payload_bytes" else pa.string())
                                              for n, c in zip(names, columns)], names)
        if stream is not None:
            stream.close()

    found = dealt.mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, "
                                   "record_type string, refers_to string")
    return found.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn(
        "refers_to", F.col("refers_to").cast(page_type))


def round_trip(pages: DataFrame, captured: Column, least_bytes: int = 0, **options) -> DataFrame:
    """Write archives and index to a new folder in shared storage, and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = merge_runs(write_archives(pages, folder, captured, least_bytes, **options), folder)
    kind = pages.schema[options.get("page_id", "page_id")].dataType.simpleString()
    return read_archives(index, folder, kind)
