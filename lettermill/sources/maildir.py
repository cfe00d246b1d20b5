"""Maildir directories: one raw message per file, named after its content.

Writing has two steps, both on the executors.  First all content goes to files
in ``tmp/``; then, when every message of the fetch is written and has its
name, the files are linked into ``new/``.  Nothing is visible before that, no
name is ever overwritten, and only names, never content, move between tasks.
The directory must be on a file system that all executors mount at one path.

Every message has a name of its own.  Copies of one content that a task comes across in one
fetch are hard links to one file, as mail in a Maildir is renamed and removed, not changed.

A directory cannot have any number of names (ext4 refuses some after 4,300,000 of this length).
When ``new/`` would have more than 262,144, names go by a checksum into 16, 256 or 4,096 folders
below the Maildir, ``.IAH-…`` with ``tmp/``, ``new/`` and ``cur/`` each, as Maildir++ has them.
What was there stays where it is, and its names are taken there too.

:func:`write_maildir` keeps a journal in ``tmp/``.  Its name says how far a write has come:

``IAP_….link``    all content is written; its names are being linked
``IAP_….undo``    a name could not be linked; all links are being taken back
``IAP_….clear``   all names are linked; the files in ``tmp/`` are being removed

A journal holds the listings of the tasks, one name for each; every step is a job over these
listings that may be done again.  When the driver dies, :func:`finish_maildir`, which the next
write calls first, ends what it was at: everything is shown in the end, or nothing.

Names that were given out are also kept in ``numbers/``, a table by hash, so that numbering
looks up the contents at hand and lists nothing.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import socket
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lettermill.functions.content import maildir_name
from lettermill.schema import MESSAGE_KEY
from lettermill.session import ship_package

# files that a task remembers, to give copies of their content a link to them
_SHARED = 100_000
# names that a directory is meant to have, and digits of the folders that share more of them
_FOLDER = 1 << 18
_LEVELS = 3
# files that a task has open at a time, and names it links between syncs of folders
_OPEN = 500
_LINKED = 100_000
# of mail that a task reads at a time
_READ_BYTES = 8 << 20
_FOLDER_NAME = re.compile(rf"\.IAH-[0-9a-f]{{1,{_LEVELS}}}")
_NAME = r"IAH_([0-9a-f]{64})_([0-9]+)\.([^,]*),S=([0-9]+)"


def make_maildir(path: str) -> str:
    root = os.path.expanduser(path)
    for part in ("tmp", "new", "cur"):
        os.makedirs(os.path.join(root, part), exist_ok=True)
    return root


def make_room(path: str, n: int, most: int | None = None) -> None:
    """Folders for ``n`` names more, if ``new/`` is not for so many; they stay."""
    most = most or _FOLDER
    root = make_maildir(path)
    level = _level(root)
    have = max(_entries(os.path.join(root, _folder(0, level), part), most) for part in ("new", "cur"))
    wanted = level
    while wanted < _LEVELS and have + n / 16**wanted > most:
        wanted, have = wanted + 1, 0
    if wanted > level:
        for k in reversed(range(16**wanted)):  # the first one last: it tells that all are there
            folder = make_maildir(os.path.join(root, _folder(k, wanted)))
            open(os.path.join(folder, "maildirfolder"), "a").close()


def _folder(k: int, level: int) -> str:
    return f".IAH-{k:0{level}x}" if level else ""


def _level(root: str) -> int:
    """How many digits the folders have that names go into now; 0 for ``new/`` itself."""
    return next((n for n in range(_LEVELS, 0, -1) if os.path.isdir(os.path.join(root, _folder(0, n)))), 0)


def _entries(path: str, most: int) -> int:
    """How many names a directory has; more than ``most`` are not counted."""
    with os.scandir(path) as entries:
        return sum(1 for _ in itertools.islice(entries, most + 1))


def _place(root: str, name: str, level: int) -> str:
    """Where a name lies, or would lie, by the folders of a level."""
    folder = _folder(zlib.crc32(name.encode()) >> 32 - 4 * level, level) if level else ""
    return os.path.join(root, folder, "new", name)


def _older(root: str, level: int) -> list[int]:
    """Levels whose folders had names before there were those of ``level``."""
    found = []
    for k in range(level):
        places = [os.path.join(root, _folder(n, k), "new") for n in range(16**k)]
        if os.path.isdir(places[0]) and any(map(_any_entry, places)):
            found.append(k)
    return found


def _any_entry(path: str) -> bool:
    with os.scandir(path) as entries:
        return next(entries, None) is not None


def _names_per_file(root: str) -> int:
    """How many names a file may get besides the one in ``tmp/``."""
    try:
        return os.pathconf(os.path.join(root, "tmp"), "PC_LINK_MAX") - 1
    except (OSError, ValueError):
        return 1


class _TaskFiles:
    """What a task writes to ``tmp/``: folders of its own, and files that copies share.

    Copies get the name of the file itself, as often as it may have names later.
    """

    def __init__(self, root: str, host: str):
        self.root, self.host, self.name = root, host, f"IAP_{uuid.uuid4().hex}"
        self.shared: dict[str, str] = {}
        self.lent: dict[str, int] = {}
        self.folders: list[str] = []
        self.most, self.n = _names_per_file(root), 0

    def write(self, raw: list[bytes], hashes: Sequence[str | None]) -> list[tuple[str | None, str | None]]:
        folder = f"{self.name}-{self.n // _FOLDER}"
        if folder not in self.folders:
            self.folders.append(folder)
            with suppress(OSError):  # then no file can be opened there, which is told for each
                os.mkdir(os.path.join(self.root, "tmp", folder))
        self.n += len(raw)
        return _write_tmp(self.root, raw, self.host, hashes, self.shared, f"{folder}/", self.lent, self.most)

    def forget(self) -> None:
        self.shared.clear()
        self.lent.clear()

    def sync(self) -> None:
        for folder in self.folders:
            _sync_directory(os.path.join(self.root, "tmp", folder))


def _remove_folders(root: str, folders: Iterable[str]) -> None:
    """Remove folders of tasks in ``tmp/`` that have no files left."""
    for folder in folders:
        if folder:
            with suppress(OSError):
                os.rmdir(os.path.join(root, "tmp", folder))


def _write_tmp(
    root: str, raw: list[bytes], host: str, hashes: Sequence[str | None] = (),
    shared: dict[str, str] | None = None, folder: str = "", lent: dict[str, int] | None = None, most: int = 0,
) -> list[tuple[str | None, str | None]]:
    """Write messages to ``tmp/`` and sync them; (file name, error) for each.

    With ``hashes`` of the messages, ``shared`` is what this task has written so far, file name
    by hash: a copy of that gets a link to the file, under a name of its own.  With ``lent``, how
    often files were given to copies, it gets the name of the file itself, ``most`` times a file.
    """
    stamp = f"{folder}IAP_{uuid.uuid4().hex}"
    names = [f"{stamp}_{n}.{host},S={len(data)}.part" for n, data in enumerate(raw)]
    if shared is None:
        return _write_files(root, names, raw)
    results: dict[int, tuple[str | None, str | None]] = {}

    def keep(n: int) -> None:
        shared[hashes[n]] = names[n]
        if lent is not None:
            lent[hashes[n]] = 1

    def copy_of(n: int) -> str | None:
        """The name in ``tmp/`` that a copy gets, if there is a file for it."""
        digest, source = hashes[n], shared.get(hashes[n])
        if source is None or lent is None:
            return names[n] if _link_tmp(root, source, names[n]) else None
        if lent[digest] >= most:
            return None
        lent[digest] += 1
        return source

    first: dict[str, int] = {}
    own, copies = [], []
    for n, digest in enumerate(hashes):
        if digest is not None and digest in first:
            copies.append(n)
        elif found := copy_of(n):
            results[n] = (found, None)
        else:
            own.append(n)
            if digest is not None:
                first[digest] = n
    for n, result in zip(own, _write_files(root, [names[n] for n in own], [raw[n] for n in own])):
        results[n] = result
        if result[0] and hashes[n] is not None:
            keep(n)
    left = []
    for n in copies:
        if found := copy_of(n):
            results[n] = (found, None)
        else:  # its file was not written, or has as many names as a file may have
            left.append(n)
    results.update(zip(left, _write_files(root, [names[n] for n in left], [raw[n] for n in left])))
    for digest in list(itertools.islice(shared, max(0, len(shared) - _SHARED))):
        del shared[digest]
        if lent is not None:
            del lent[digest]
    return [results[n] for n in range(len(raw))]


def _link_tmp(root: str, source: str | None, name: str) -> bool:
    if source is None:
        return False
    try:
        os.link(os.path.join(root, "tmp", source), os.path.join(root, "tmp", name))
    except OSError:
        return False
    return True


def _write_files(root: str, names: list[str], raw: list[bytes]) -> list[tuple[str | None, str | None]]:
    results = []
    for at in range(0, len(names), _OPEN):
        results += _write_some(root, names[at:at + _OPEN], raw[at:at + _OPEN])
    return results


def _write_some(root: str, names: list[str], raw: list[bytes]) -> list[tuple[str | None, str | None]]:
    opened, results = [], []
    for name, data in zip(names, raw):
        path = os.path.join(root, "tmp", name)
        try:
            file = open(path, "xb")
        except OSError as exc:
            results.append((None, str(exc)))
            continue
        try:
            file.write(data)
            opened.append((len(results), file))
            results.append((name, None))
        except OSError as exc:
            with suppress(OSError):
                file.close()
            _unlink(path)
            results.append((None, str(exc)))
    # One round of syncs after all writes, side by side: the file system can
    # then put many of them into one disk write.
    with ThreadPoolExecutor(16) as pool:  # starts no thread where nothing was opened
        for (at, _), error in zip(opened, pool.map(lambda o: _sync_file(o[1]), opened)):
            if error:
                results[at] = (None, error)
    return results


def _sync_file(file: BinaryIO) -> str | None:
    try:
        with file:
            file.flush()
            os.fsync(file.fileno())
    except OSError as exc:
        _unlink(file.name)
        return str(exc)
    return None


def _unlink(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def _link(root: str, tmp_name: str, name: str, level: int, older: Iterable[int], touched: set[str]) -> str | None:
    """Give a finished file a name; an error text or None.  ``touched`` are directories to sync.

    A repeated task finds its own earlier work and accepts it.
    """
    source, target = os.path.join(root, "tmp", tmp_name), _place(root, name, level)
    touched.add(os.path.dirname(target))
    try:
        for k in older:
            if os.path.exists(there := _place(root, name, k)):
                return None if os.path.samefile(source, there) else f"name is taken: {name}"
        os.link(source, target)
    except FileExistsError:
        if not os.path.samefile(source, target):
            return f"name is taken: {name}"
    except OSError as exc:
        return str(exc)
    return None


def _publish(root: str, tmp_name: str, name: str, level: int, older: Iterable[int], touched: set[str]) -> str | None:
    """As :func:`_link`; a file that is gone from ``tmp/`` has had all its names."""
    error = _link(root, tmp_name, name, level, older, touched)
    if error is None or os.path.exists(os.path.join(root, "tmp", tmp_name)):
        return error
    if any(os.path.exists(_place(root, name, k)) for k in (*older, level)):
        return None
    return f"file is gone: {tmp_name}"


def _sync_directory(path: str) -> None:
    handle = os.open(path, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def write_tmp_files(clean: DataFrame, path: str, host: str | None = None) -> DataFrame:
    """First step: key, hash, length, ``tmp_name`` (null when the write failed)."""
    ship_package(clean.sparkSession)
    root, host = make_maildir(path), host or socket.gethostname()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _TaskFiles(root, host)
        for batch in batches:
            raw, hashes = batch.column("raw").to_pylist(), batch.column("msg_hash").to_pylist()
            written = files.write(raw, hashes)
            made = [pa.array(column, pa.string()) for column in zip(*written)] or [pa.nulls(0, pa.string())] * 2
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *made], [*kept, "tmp_name", "detail"])

    kept = [*MESSAGE_KEY, "msg_hash", "length"]
    return clean.select(
        "account", "folder", F.col("uid").cast("bigint").alias("uid"), "msg_hash",
        F.col("length").cast("bigint").alias("length"),
        F.concat(F.col("header").cast("binary"), F.col("body").cast("binary")).alias("raw"),
    ).mapInArrow(
        run,
        "account string, folder string, uid bigint, msg_hash string, length bigint, "
        "tmp_name string, detail string",
    )


def discard_files(written: DataFrame, path: str, shown: DataFrame) -> DataFrame:
    """Remove files of the first step that are not to be shown, unless copies of them are among
    ``shown``; returns their keys."""
    ship_package(written.sparkSession)
    root = os.path.expanduser(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["tmp_name"]:
                _unlink(os.path.join(root, "tmp", name))
            _remove_folders(root, {os.path.dirname(name) for name in batch["tmp_name"]})
            yield batch[MESSAGE_KEY]

    rows = written.filter("tmp_name is not null").select(*MESSAGE_KEY, "tmp_name")
    return rows.join(shown.select("tmp_name"), "tmp_name", "left_anti").select(
        *MESSAGE_KEY, "tmp_name").mapInPandas(run, "account string, folder string, uid bigint")


def _together(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def publish_files(named: DataFrame, path: str) -> DataFrame:
    """Second step: link files into ``new/``; key, ``ok`` and ``detail``.

    All names of a file are given by one task, which then removes it from ``tmp/``.  A directory
    that cannot be synced fails everything linked before it.
    """
    ship_package(named.sparkSession)
    root = make_maildir(path)
    level = _level(root)
    older = _older(root, level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, failed, folders = None, False, set()
        for batch in _together(batches, _LINKED if level else 1):
            errors, touched, ended = [], set(), []
            for tmp, name in zip(batch["tmp_name"], batch["name"]):
                if tmp != file:
                    ended += [] if file is None or failed else [file]
                    folders.add(os.path.dirname(tmp))
                    file, failed = tmp, False
                errors.append(_publish(root, tmp, name, level, older, touched))
                failed = failed or errors[-1] is not None
            try:
                for place in touched:
                    _sync_directory(place)
            except OSError as exc:
                errors = [f"failed to sync: {exc}"] * len(errors)
            for tmp in ended:
                _unlink(os.path.join(root, "tmp", tmp))
            out = batch[MESSAGE_KEY].copy()
            out["ok"] = [e is None for e in errors]
            out["detail"] = errors
            yield out
        if file is not None and not failed:
            _unlink(os.path.join(root, "tmp", file))
        _remove_folders(root, folders)

    rows = named.select(*MESSAGE_KEY, "tmp_name", "name")
    return rows.repartition("tmp_name").sortWithinPartitions("tmp_name").mapInPandas(
        run, "account string, folder string, uid bigint, ok boolean, detail string"
    )


def list_maildir(spark: SparkSession, path: str) -> DataFrame:
    """(part, name) of the files in ``new/`` and ``cur/``, also of the folders that share them.

    Each directory is listed by one task, name by name, so a long listing is
    neither held in memory nor sent to the driver.
    """
    ship_package(spark)
    root = make_maildir(path)
    with os.scandir(root) as entries:
        folders = sorted(e.name for e in entries if _FOLDER_NAME.fullmatch(e.name))
    parts = ["new", "cur", *(f"{folder}/{part}" for folder in folders for part in ("new", "cur"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in map(parts.__getitem__, batch["id"]):
                with os.scandir(os.path.join(root, part)) as entries:
                    while names := [e.name for e in itertools.islice(entries, 10_000)]:
                        yield pd.DataFrame({"part": part, "name": names})

    return spark.range(0, len(parts), 1, min(len(parts), 128)).mapInPandas(run, "part string, name string")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("msg_hash", F.regexp_extract("name", _NAME, 1)).withColumn(
        "dup_no", F.regexp_extract("name", _NAME, 2).try_cast("bigint")
    )


def maildir_names(spark: SparkSession, path: str) -> DataFrame:
    """(msg_hash, dup_no) of the files of a Maildir that carry such names, by listing it."""
    return _named(list_maildir(spark, path)).filter("msg_hash <> ''").select("msg_hash", "dup_no")


_NUMBERS = "msg_hash STRING, dup_no BIGINT"


def given_numbers(spark: SparkSession, path: str, hashes: DataFrame | None = None) -> DataFrame:
    """(msg_hash, dup_no): the largest number that each content has had in a Maildir.

    Only what ``hashes`` (msg_hash) has, if given: the table is stored by the first two digits
    of the hash, and other digits are not read.  The first call lists the Maildir; if names of
    this form are added by others later, :func:`renumber_maildir` lists it again.
    """
    place = f"file:{make_maildir(path)}/numbers"
    if not os.path.exists(f"{make_maildir(path)}/numbers/_SUCCESS"):
        renumber_maildir(spark, path)
    rows = spark.read.schema(f"{_NUMBERS}, prefix STRING").parquet(place)
    if hashes is not None:
        wanted = hashes.select("msg_hash", F.substring("msg_hash", 1, 2).alias("prefix")).distinct()
        rows = rows.join(wanted, ["prefix", "msg_hash"], "left_semi")
    return rows.groupBy("msg_hash").agg(F.max("dup_no").alias("dup_no"))


def renumber_maildir(spark: SparkSession, path: str) -> None:
    """Make the table of given numbers anew from a listing of the Maildir."""
    _keep_numbers(maildir_names(spark, path), path, "overwrite")


def keep_numbers(named: DataFrame, path: str) -> None:
    """Note numbers before their files are shown; one that is not used after all leaves a gap."""
    given_numbers(named.sparkSession, path)  # there is a table
    _keep_numbers(named, path, "append")


def _keep_numbers(rows: DataFrame, path: str, mode: str) -> None:
    largest = rows.groupBy("msg_hash").agg(F.max("dup_no").cast("bigint").alias("dup_no"))
    largest.withColumn("prefix", F.substring("msg_hash", 1, 2)).hint("rebalance", "prefix").write.mode(
        mode).partitionBy("prefix").parquet(f"file:{make_maildir(path)}/numbers")


def ingest_maildir(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Messages of a Maildir with name, hash, duplicate number, header and body.

    Files are opened by Python tasks: Spark's file sources skip empty files and
    cannot open names with a colon, which mail readers put into ``cur/``.
    """
    root = os.path.expanduser(path)
    tasks = tasks or max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )

    def read(part: str, name: str) -> bytes:
        with open(os.path.join(root, part, name), "rb") as file:
            return file.read()

    def packed(rows: list[tuple[str, int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for part, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist()):
                content = read(part, name)
                end = _header_end(content)
                rows.append((name, len(content), content[:end], content[end:]))
                size += len(content)
                if len(rows) >= 1024 or size >= _READ_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    columns = ["name", "length", "header", "body"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    names = list_maildir(spark, path).repartition(tasks, "name")
    files = names.mapInArrow(run, "name string, length bigint, header binary, body binary")
    return _named(files).select("name", "msg_hash", "dup_no", "length", "header", "body")


def _header_end(content: bytes) -> int:
    """Where :func:`split_message` splits: after the first blank line, LF LF or CR LF CR LF."""
    if content.startswith(b"\n"):
        return 1
    if content.startswith(b"\r\n"):
        return 2
    lf, crlf = content.find(b"\n\n"), content.find(b"\n\r\n")
    ends = [at + width for at, width in ((lf, 2), (crlf, 3)) if at >= 0]
    return min(ends, default=len(content))


def add_names(rows: DataFrame, host: str | None = None) -> DataFrame:
    """Add ``name`` from hash, duplicate number and length."""
    return rows.withColumn(
        "name",
        maildir_name(
            F.col("msg_hash"), F.col("dup_no"), F.lit(host or socket.gethostname()), F.col("length")
        ),
    )


@dataclass
class _Written(WriterCommitMessage):
    """Where a task has listed its files: one line for each, name in ``tmp/`` and final name."""

    listing: str
    n: int


class _MaildirWriter(DataSourceArrowWriter):
    """Tasks fill ``tmp/`` and list what they wrote; the commit of the job makes it the journal.

    When a task fails, nothing stays in ``tmp/``.
    """

    def __init__(self, path: str, journal: str, most: int):
        self.path, self.journal, self.most = path, journal, most

    def write(self, iterator) -> WriterCommitMessage:
        root, host = make_maildir(self.path), socket.gethostname()
        listing = f"IAP_{uuid.uuid4().hex}.list"
        files, listed = _TaskFiles(root, host), 0
        given: set[str] = set()
        try:
            with open(os.path.join(root, "tmp", listing), "x", encoding="utf-8") as out:
                for batch in iterator:
                    rows = batch.to_pydict()
                    raw = [bytes(h) + bytes(b) for h, b in zip(rows["header"], rows["body"])]
                    if len(given) > _SHARED:
                        given.clear()
                        files.forget()
                    hashes = []
                    for data, name in zip(raw, rows["name"]):
                        # a name that comes again gets a file of its own, so that it is found taken
                        hashes.append(None if name in given else hashlib.sha256(data).hexdigest())
                        given.add(name)
                    written = files.write(raw, hashes)
                    listed += len(raw)
                    out.writelines(
                        f"{tmp}\t{name}\n" for (tmp, _), name in zip(written, rows["name"]) if tmp
                    )
                    failed = [error for _, error in written if error]
                    if failed:
                        raise OSError(f"{len(failed)} messages not written: {failed[0]}")
                out.flush()
                os.fsync(out.fileno())
            files.sync()
        except BaseException:
            _drop(root, listing)
            _remove_folders(root, files.folders)
            raise
        return _Written(listing, listed)

    def commit(self, messages) -> None:
        """From here on the write is finished by whoever comes next."""
        make_room(self.path, sum(m.n for m in messages if m is not None), self.most)
        tmp = os.path.join(os.path.expanduser(self.path), "tmp")
        with open(os.path.join(tmp, f"{self.journal}.new"), "x", encoding="utf-8") as out:
            out.writelines(f"{m.listing}\n" for m in messages if m is not None)
            out.flush()
            os.fsync(out.fileno())
        os.rename(os.path.join(tmp, f"{self.journal}.new"), os.path.join(tmp, f"{self.journal}.link"))
        _sync_directory(tmp)

    def abort(self, messages) -> None:
        for message in messages:
            if message is not None:
                _drop(os.path.expanduser(self.path), message.listing)


def _listed(root: str, listing: str) -> Iterator[list[str]]:
    """Pairs of names; none if the listing is gone, because its step was done before."""
    with suppress(FileNotFoundError):
        with open(os.path.join(root, "tmp", listing), encoding="utf-8") as lines:
            for line in lines:
                yield line.rstrip("\n").split("\t")


def _drop(root: str, listing: str) -> None:
    """Remove the files of a listing that are still in ``tmp/``, and the listing."""
    folders, before = set(), None
    for tmp, _ in _listed(root, listing):
        if tmp != before:  # copies have the name of one file
            _unlink(os.path.join(root, "tmp", tmp))
            folders.add(os.path.dirname(tmp))
            before = tmp
    _remove_folders(root, folders)
    _unlink(os.path.join(root, "tmp", listing))


def _link_listing(root: str, listing: str) -> str | None:
    """Link all names of a listing; the first error, if any.  Names that are linked stay so."""
    first, touched, level = None, set(), _level(root)
    older = _older(root, level)
    for tmp, name in _listed(root, listing):
        error = _link(root, tmp, name, level, older, touched)
        first = first or error
    try:
        for place in touched:
            _sync_directory(place)
    except OSError as exc:
        first = first or f"failed to sync: {exc}"
    return first


def _unlink_listing(root: str, listing: str) -> None:
    """Take back the names of a listing that lead to its own files, then the files."""
    for tmp, name in _listed(root, listing):
        for level in range(_LEVELS + 1):
            with suppress(FileNotFoundError):
                if os.path.samefile(os.path.join(root, "tmp", tmp), place := _place(root, name, level)):
                    _unlink(place)
    _drop(root, listing)


_STEPS = {"link": _link_listing, "undo": _unlink_listing, "clear": _drop}


def _step(spark: SparkSession, root: str, journal: str, step: str) -> str | None:
    """Do one step for all listings of a journal, side by side; the first error."""
    do = _STEPS[step]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"error": [do(root, listing) for listing in batch["value"]]}, dtype=object)

    # the journal is a text file of one line a task
    listings = spark.read.text("file:" + os.path.join(root, "tmp", f"{journal}.{step}"))
    tasks = max(1, listings.count())
    errors = listings.repartition(tasks, "value").mapInPandas(run, "error string")
    return errors.agg(F.min("error")).first()[0]


def _finish(spark: SparkSession, root: str, journal: str, step: str) -> str | None:
    """Bring a write from ``step`` to its end; the error that made it be taken back."""
    tmp, error = os.path.join(root, "tmp"), None
    if step == "link":
        error = _step(spark, root, journal, step)
        step = "undo" if error else "clear"
        os.rename(os.path.join(tmp, f"{journal}.link"), os.path.join(tmp, f"{journal}.{step}"))
        _sync_directory(tmp)
    _step(spark, root, journal, step)
    _unlink(os.path.join(tmp, f"{journal}.{step}"))
    return error


def finish_maildir(spark: SparkSession, path: str) -> dict[str, str | None]:
    """End writes whose driver died after all content was written; journal and error of each.

    Not for use while another application writes to the same Maildir.
    """
    ship_package(spark)
    root, found = make_maildir(path), {}
    with os.scandir(os.path.join(root, "tmp")) as entries:
        open_ones = sorted(e.name for e in entries if e.name.endswith(tuple(f".{s}" for s in _STEPS)))
    for name in open_ones:  # one for each write that was interrupted
        journal, step = name.rsplit(".", 1)
        found[journal] = _finish(spark, root, journal, step)
    return found


class MaildirDataSource(DataSource):
    """``df.write.format("maildir")`` for rows with name, header and body.

    This is the first half of :func:`write_maildir`; :func:`finish_maildir` shows the files.
    """

    @classmethod
    def name(cls) -> str:
        return "maildir"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a Maildir is only ever added to")
        journal = self.options.get("journal") or f"IAP_{uuid.uuid4().hex}"
        return _MaildirWriter(self.options["path"], journal, int(self.options.get("names", _FOLDER)))


def write_maildir(named: DataFrame, path: str) -> None:
    """Write rows that already have unique names (see ``add_names``): all of them, or none.

    No task and no driver goes through all names: each of the writing tasks lists its own, and
    the steps after that are jobs over the listings.  A write that an earlier driver left
    behind is ended first.
    """
    spark = named.sparkSession
    ship_package(spark)
    root = make_maildir(path)
    finish_maildir(spark, path)
    spark.dataSource.register(MaildirDataSource)
    journal = f"IAP_{uuid.uuid4().hex}"
    named.select(
        "name", F.col("header").cast("binary").alias("header"),
        F.col("body").cast("binary").alias("body"),
    ).write.format("maildir").mode("append").option("journal", journal).option("names", _FOLDER).save(root)
    error = _finish(spark, root, journal, "link")
    if error:
        raise OSError(error)
