"""Commands applied one after another to one mailbox state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.operators import delivery as dlv
from lettermill.operators import transitions as tr
from lettermill.operators.batching import size_batches
from lettermill.operators.counting import count_by_folder
from lettermill.operators.delivery import conflicts
from lettermill.operators.filters import to_ns
from lettermill.operators.folders import FolderChoice
from lettermill.operators.ranking import duplicate_number
from lettermill.operators.safety import guard_delete
from lettermill.plans.commands import (
    CallTarget,
    Command,
    Count,
    Delete,
    Fetch,
    MaildirTarget,
    Mark,
    TableTarget,
    prepare,
)
from lettermill.schema import (
    CONTENT_KEY,
    FOLDER_KEY,
    MESSAGE_KEY,
    MESSAGES,
    OUTCOMES,
    TRASH_FOLDER,
    TRASH_LABEL,
)
from lettermill.session import attach, materialise, scratch_path
from lettermill.sources.archive_table import (
    read_archive_index,
    write_archive_content,
    write_archive_index,
)
from lettermill.sources.maildir import (
    add_names,
    discard_files,
    given_numbers,
    keep_numbers,
    make_room,
    publish_files,
    write_tmp_files,
)

_HASHED_KEYS = 4_000_000
_PASSES = 8
_SOURCES = 20
_CONTENT = ("header", "body")
_ADDRESS = ["_address", "_check"]
_OUTCOME_COLUMNS = [field.split()[0] for field in OUTCOMES.split(", ")]


class CatastrophicFailure(RuntimeError):
    """A paranoid fetch delivered only a part of a batch; the run ended there."""

    def __init__(self, result: "Result"):
        super().__init__("a batch was delivered in part, in paranoid mode")
        self.result = result


@dataclass(frozen=True)
class Mailbox:
    """State of a mailbox.  Without ``contents``, messages carry header and body.

    ``last_uids`` has the largest UIDs that trash folders ever had (``account``, ``folder``,
    ``uid``), so that a run knows them after the mail is gone.
    """

    accounts: DataFrame
    folders: DataFrame
    messages: DataFrame
    contents: DataFrame | None = None
    last_uids: DataFrame | None = None


@dataclass(frozen=True)
class Result:
    messages: DataFrame
    outcomes: DataFrame
    counts: DataFrame | None  # of count commands and dry runs
    last_uids: DataFrame | None = None  # for the next run's mailbox


@contextmanager
def _small_arrow_batches(spark: SparkSession, rows: int = 256):
    """Content rows are large: pass few of them to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    speculation = spark.sparkContext.getConf().get("spark.speculation", "false")
    if speculation == "true":
        raise RuntimeError("turn spark.speculation off for deliveries: it runs tasks twice")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Inline:
    """Content that came in one table with its messages.

    It stays there: commands change a narrow state, in which each message has the address of its
    row in that table: 128 bits of hash, never null.  Copies of a row have one address.
    """

    def __init__(self, messages: DataFrame):
        known = [field.split()[0] for field in MESSAGES.split(", ")]
        facts = [c for c in known if c in messages.columns and c not in MESSAGE_KEY]
        self.columns = messages.columns
        # not of the content: a join by address can then take place before that is read
        self.address = [F.xxhash64(*MESSAGE_KEY, *facts),
                        F.xxhash64(F.lit("check"), *MESSAGE_KEY, *facts)]
        named = [column.alias(name) for column, name in zip(self.address, _ADDRESS)]
        self.rows = messages.select("*", *named)

    def state(self) -> DataFrame:
        return self.rows.drop(*_CONTENT)

    def content_at(self, wanted: DataFrame, moved: bool) -> DataFrame:
        """Key, header and body of messages of the state, ``moved`` if they may have new keys."""
        at = wanted.select(F.col("_address").alias("_at"), F.col("_check").alias("_at_check"))
        # Spark moves a join by expressions, not one by their names, before the join of content
        hit = (self.address[0] == F.col("_at")) & (self.address[1] == F.col("_at_check"))
        rows = self.rows.join(at, hit, "left_semi")
        if moved:
            rows = rows.select(*_ADDRESS, *_CONTENT).join(wanted.select(*MESSAGE_KEY, *_ADDRESS), _ADDRESS)
        return rows.select(*MESSAGE_KEY, *_CONTENT)

    def with_content(self, state: DataFrame) -> DataFrame:
        """Messages of the state as they came in; content is only read if it is asked for."""
        parts = self.rows.groupBy(*_ADDRESS).agg(F.collect_list(F.struct(*_CONTENT)).alias("_parts"))
        copy = F.row_number().over(Window.partitionBy(*_ADDRESS).orderBy("folder", "uid"))
        rows = state.withColumn("_copy", copy).join(parts, _ADDRESS, "left")
        part = F.expr("element_at(_parts, int((_copy - 1) % size(_parts)) + 1)")
        return rows.select(*[part[c].alias(c) if c in _CONTENT else F.col(c) for c in self.columns])


def _content_of(
    box: Mailbox, wanted: DataFrame, condition: Column, units: DataFrame, inline: _Inline | None = None,
    by_address: bool = False, moved: bool = False,
) -> DataFrame:
    """Key, header and body of the wanted messages that have content.

    Inline content is read where it lies: what is wanted are the messages of ``condition``
    in the visited folders that have a size, or ``by_address``, once messages have changed or
    when only some are wanted, those at the addresses of the wanted.  Stored content stays where it lies too if it is
    bucketed by its key: only keys are sent to it.  Messages that know the batch they came
    with (``origin_batch``) also say which files and row groups need not be read.
    """
    if inline is not None:
        if by_address:
            return inline.content_at(wanted, moved)
        rows = inline.rows.filter(condition & F.col("size").isNotNull())
        visited = attach(rows, units.select(*FOLDER_KEY), FOLDER_KEY, "left_semi")
        return visited.select(*MESSAGE_KEY, *_CONTENT)
    address = [*CONTENT_KEY, *(c for c in ("origin_batch",) if c in box.contents.columns)]
    # Written: keys that a join before has dealt out would have content dealt out like them.
    keys = materialise(wanted.select(*MESSAGE_KEY, *[c for c in address if c not in MESSAGE_KEY]), "keys")
    n, among = _extent(keys) if "origin_batch" in address else (keys.count(), F.lit(True))
    contents, passes = box.contents.filter(among), -(-n // _HASHED_KEYS)
    if passes > _PASSES:  # sorted, which may spill
        return keys.join(contents, address).select(*MESSAGE_KEY, "header", "body")
    found = []
    for k in range(max(1, passes)):  # so many keys at a time as fit into memory
        some = keys if passes < 2 else keys.filter(F.pmod(F.xxhash64(*address), F.lit(passes)) == k)
        found.append(some.hint("shuffle_hash").join(contents, address).select(*MESSAGE_KEY, "header", "body"))
    return reduce(DataFrame.unionByName, found)


def _extent(keys: DataFrame) -> tuple[int, Column]:
    """How many keys there are, and a condition on ``origin_batch`` that Parquet statistics can
    decide for whole files: the range of batches of each source, or of all of them together
    where there are many sources."""
    facts = [F.min("origin_batch").alias("low"), F.max("origin_batch").alias("high"), F.count("*").alias("n")]
    ranges = keys.groupBy(F.substring_index("origin_batch", "/", 1).alias("source")).agg(*facts)
    found = ranges.limit(_SOURCES + 1).collect()
    if len(found) > _SOURCES:
        found = keys.agg(*facts).collect()
    among = F.lit(False)
    for row in found:
        among = among | F.col("origin_batch").between(row["low"], row["high"])
    return sum(row["n"] for row in found), among


def _deliver(
    box: Mailbox,
    selected: DataFrame,
    content_of: Callable[[DataFrame, bool], DataFrame],
    batches: DataFrame,
    command: Fetch,
    cycle_id: int,
    idx: int,
) -> DataFrame:
    """(key, ok, detail) of every message whose content was found and whose turn came.

    ``content_of`` reads the content of messages; its second argument says if these are only
    some of the selected ones.
    """
    spark = box.messages.sparkSession

    def clean_of(wanted: DataFrame, some: bool) -> DataFrame:
        found = content_of(wanted, some).filter(F.col("header").isNotNull() & F.col("body").isNotNull())
        return dlv.clean_content(found)

    target = command.target
    with _small_arrow_batches(spark):
        if isinstance(target, CallTarget):
            if command.mode == "yolo":
                return materialise(dlv.deliver(clean_of(selected, False), target.fn), "delivered")
            turns = batches.select("account_idx", *MESSAGE_KEY, "folder_idx", "batch_id")

            def clean_in_turn(keys: DataFrame) -> DataFrame:
                return clean_of(selected.join(keys, MESSAGE_KEY, "left_semi"), True)

            return materialise(
                dlv.deliver_in_turn(turns, target.fn, command.mode, content_of=clean_in_turn), "delivered"
            )
        clean = clean_of(selected, False)
        if isinstance(target, TableTarget):
            stored = write_archive_content(clean, target.path, cycle_id, str(idx))
            return stored.select(
                *MESSAGE_KEY, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("detail"),
                "msg_hash", "length",
            )
        written = materialise(write_tmp_files(clean, target.path, target.host), "tmp-files")
    # From here on only names: in large batches, as each ends with a sync of the directory.
    failed = written.filter("tmp_name is null").select(
        *MESSAGE_KEY, F.lit(False).alias("ok"), "detail"
    )
    ready = written.filter("tmp_name is not null")
    if command.mode != "yolo":
        # What comes after a stop is not shown.
        tried = batches.join(
            written.select(*MESSAGE_KEY, F.col("tmp_name").isNotNull().alias("ok")),
            MESSAGE_KEY, "left",
        )
        judged = dlv.delivery_outcome(tried, command.mode)
        late = materialise(judged.filter("status = 'not_attempted'").select(*MESSAGE_KEY), "late")
        shown = ready.join(late, MESSAGE_KEY, "left_anti")
        discard_files(ready.join(late, MESSAGE_KEY), target.path, shown).write.format("noop").mode(
            "overwrite").save()
        ready = shown
    placed = _in_order(ready, box)
    earlier = given_numbers(spark, target.path, ready)
    named = add_names(duplicate_number(placed, earlier, stored=True), target.host)
    # Names are decided once, and noted, before the first file gets one.
    named = materialise(named, "names")
    keep_numbers(named, target.path)
    make_room(target.path, named.count())
    published = materialise(publish_files(named, target.path), "delivered")
    return published.unionByName(failed)


def _in_order(rows: DataFrame, box: Mailbox) -> DataFrame:
    order = box.folders.select("account_idx", *FOLDER_KEY, "folder_idx")
    return attach(rows, order, FOLDER_KEY)


def _outcomes(rows: DataFrame, cycle_id: int, idx: int, command: str) -> DataFrame:
    present = set(rows.columns)
    types = dict(field.split() for field in OUTCOMES.split(", "))
    fixed = {"cycle_id": cycle_id, "command_idx": idx, "command": command}
    return rows.select(
        *[
            (
                F.lit(fixed[name])
                if name in fixed
                else F.col(name) if name in present else F.lit(None)
            ).cast(types[name]).alias(name)
            for name in _OUTCOME_COLUMNS
        ]
    )


class _Run:
    """One pass of commands over a mailbox."""

    def __init__(self, box: Mailbox, cycle_id: int, now_ns: int):
        self.cycle_id, self.now_ns = cycle_id, now_ns
        self.spark = box.messages.sparkSession
        self.inline: _Inline | None = None
        if box.contents is None and set(_CONTENT) <= set(box.messages.columns):
            self.inline = _Inline(box.messages)
            box = replace(box, messages=materialise(self.inline.state(), "state"))
        # Written, so that joins know how few they are, and send them instead of the messages.
        box = replace(box, accounts=materialise(box.accounts, "accounts"),
                      folders=materialise(box.folders, "folders"))
        self.box = box
        self.start = box.messages
        self.changed = self.moved = False  # messages, and keys of them, since the start
        self.last_uids = tr.last_uids(box.messages, box.last_uids)
        self.outcome_paths: list[str] = []
        self.counts: list[DataFrame] = []
        self.stopped: DataFrame | None = None  # accounts to leave alone
        self.run_stop: int | None = None  # index of the account a run ended at

    # -- outcomes ---------------------------------------------------------

    def record(self, rows: DataFrame, idx: int, command: str) -> DataFrame:
        """Persist outcomes before any state change that follows from them."""
        path = scratch_path(self.spark, f"outcomes-{idx}")
        _outcomes(rows, self.cycle_id, idx, command).write.parquet(path)
        self.outcome_paths.append(path)
        return self.spark.read.schema(OUTCOMES).parquet(path)

    def outcomes(self) -> DataFrame:
        if not self.outcome_paths:
            return self.spark.createDataFrame([], OUTCOMES)
        return self.spark.read.schema(OUTCOMES).parquet(*self.outcome_paths)

    # -- what a command visits ---------------------------------------------

    def units(self, choice: FolderChoice, idx: int) -> DataFrame:
        accounts = self.box.accounts.select("account", F.col("host").alias("host"))
        units = choice.select(self.box.folders).select("account_idx", *FOLDER_KEY, "folder_idx")
        units = units.join(accounts, "account").withColumn("command_idx", F.lit(idx))
        if self.stopped is not None:
            units = units.join(self.stopped, "account", "left_anti")
        return materialise(units, "visited")

    def selection(self, command: Command) -> Column:
        bound = command.effective_filter().bind(self.now_ns, self.spark)
        return bound.column() & command.folders.column()

    def visit(self, rows: DataFrame, units: DataFrame) -> DataFrame:
        """Rows in visited folders, with the order columns of their unit."""
        extra = [c for c in units.columns if c not in rows.columns or c in FOLDER_KEY]
        return attach(rows, units.select(*extra), FOLDER_KEY, "inner")

    def visited(self, units: DataFrame) -> DataFrame:
        """All messages, with ``_visited`` true for those in the folders of ``units``."""
        mark = units.select(*FOLDER_KEY, F.lit(True).alias("_visited"))
        known = attach(self.box.messages, mark, FOLDER_KEY)
        return known.withColumn("_visited", F.coalesce("_visited", F.lit(False)))

    def close(self, units: DataFrame) -> None:
        """Every visited folder is closed afterwards, dropping deleted messages."""
        if self.stopped is not None:
            units = units.join(self.stopped, "account", "left_anti")
        known = self.visited(units)
        self.set_messages(known.filter(~(F.col("deleted") & F.col("_visited"))).drop("_visited"))

    def set_messages(self, messages: DataFrame) -> None:
        self.changed = True
        self.box = replace(self.box, messages=messages)

    # -- commands -----------------------------------------------------------

    def run(self, idx: int, command: Command) -> None:
        missing = command.folders.unknown(self.box.folders, self.box.accounts)
        if command.folders.include:
            if self.stopped is not None:
                missing = missing.join(self.stopped, "account", "left_anti")
            self.record(missing, idx, command.kind)
        units = self.units(command.folders, idx)
        condition = self.selection(command)
        if isinstance(command, Count) or command.dry_run:
            counted = count_by_folder(self.box.messages, units, condition)
            self.counts.append(
                counted.select(
                    F.lit(idx).alias("command_idx"),
                    F.lit(command.kind).alias("command"),
                    "account_idx", "account", "folder_idx", "folder", "n",
                )
            )
        elif isinstance(command, Mark):
            self.mark(idx, command, units, condition)
        elif isinstance(command, Fetch):
            self.fetch(idx, command, units, condition)
        elif isinstance(command, Delete):
            self.delete(idx, command, units, condition)
        if not command.dry_run:
            self.close(units)

    def mark(self, idx: int, command: Mark, units: DataFrame, condition: Column) -> None:
        hits = self.visit(self.box.messages.filter(condition), units)
        self.record(hits.withColumn("status", F.lit("marked")), idx, "mark")
        known = self.visited(units)
        self.set_messages(tr.mark(known, condition & F.col("_visited"), command.how).drop("_visited"))

    def fetch(self, idx: int, command: Fetch, units: DataFrame, condition: Column) -> None:
        narrow = [c for c in self.box.messages.columns if c not in _CONTENT]
        selected = self.visit(self.box.messages.filter(condition).select(*narrow), units)
        selected, unsized = conflicts(selected, ["size"])
        self.record(unsized, idx, "fetch")
        batches = materialise(
            self.visit(
                size_batches(
                    selected, command.fetch_number, command.batch_number, command.batch_size
                ),
                units,
            ),
            "batches",
        )

        def content_of(wanted: DataFrame, some: bool) -> DataFrame:
            by_address = some or self.changed
            return _content_of(self.box, wanted, condition, units, self.inline, by_address, self.moved)

        results = _deliver(self.box, selected, content_of, batches, command, self.cycle_id, idx)
        attempts = materialise(batches.join(results, MESSAGE_KEY, "left"), "attempts")
        marked_as = command.mark_name()
        status = dlv.delivery_outcome(attempts, command.mode, marked_as != "noop")
        status = status.withColumn(
            "detail",
            F.when(
                F.col("status") == "conflict", F.lit("the result does not have this message")
            ).otherwise(F.col("detail")),
        )
        judged = materialise(
            dlv.judge_batches(dlv.batch_summary(attempts), command.mode), "judged"
        )
        done = self.record(status, idx, "fetch")
        self.record(dlv.delivery_errors(judged, str(command.target)), idx, "fetch")
        if isinstance(command.target, TableTarget):
            self.index_archive(attempts, done, command.target, idx)
        if marked_as != "noop":
            keys = done.filter("status = 'marked'")
            self.set_messages(
                materialise(tr.mark_by_key(self.box.messages, keys, marked_as), "messages")
            )
        self.note_stops(judged)

    def index_archive(
        self, attempts: DataFrame, done: DataFrame, target: TableTarget, idx: int
    ) -> None:
        arrived = done.filter(F.col("status").isin(*dlv.DELIVERED)).select(*MESSAGE_KEY)
        rows = attempts.join(arrived, MESSAGE_KEY, "left_semi").select(
            "account_idx", "folder_idx", *MESSAGE_KEY, "msg_hash", "length"
        )
        earlier = None
        try:
            earlier = read_archive_index(self.spark, target.path).filter(
                (F.col("cycle_id") < self.cycle_id)
                | ((F.col("cycle_id") == self.cycle_id) & (F.col("part").cast("int") < idx))
            )
        except Exception as exc:  # no index yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        named = add_names(duplicate_number(rows, earlier), target.host)
        write_archive_index(named, target.path, self.cycle_id, str(idx))

    def note_stops(self, judged: DataFrame) -> None:
        ended = judged.filter("stops").select("account").distinct()
        spoiled = judged.filter("spoiled").agg(F.min("account_idx")).first()[0]
        if spoiled is not None:
            self.run_stop = spoiled
        if not ended.isEmpty():
            self.stopped = (
                ended if self.stopped is None else self.stopped.union(ended).distinct()
            )

    def delete(self, idx: int, command: Delete, units: DataFrame, condition: Column) -> None:
        method = (
            tr.delete_method(F.col("host"), F.col("folder"))
            if command.method == "auto"
            else F.lit(command.method)
        )
        guarded = materialise(
            guard_delete(units, self.outcomes()).withColumn("method", method), "units"
        )
        kept = guarded.filter("guarded").withColumn("status", F.lit("error")).withColumn(
            "detail",
            F.concat(
                F.lit("errors earlier in this run: nothing deleted in folder `"), F.col("folder"), F.lit("`"),
            ),
        )
        self.record(kept, idx, "delete")
        allowed = guarded.filter("not guarded").drop("guarded")
        self.record_and_apply_delete(idx, condition, allowed)

    def record_and_apply_delete(self, idx: int, condition: Column, allowed: DataFrame) -> None:
        """Folders are visited in order, so mail moved to the trash folder is
        looked at again when that folder is visited later in the same command.
        """
        columns = self.box.messages.columns
        in_trash = F.col("folder") == TRASH_FOLDER
        trashing = F.col("method") == "gmail-trash"
        self.record(
            self.visit(self.box.messages.filter(condition & ~in_trash), allowed).withColumn(
                "status", F.when(trashing, "trashed").otherwise("deleted")
            ),
            idx, "delete",
        )
        known = attach(
            self.box.messages, allowed.select(*FOLDER_KEY, "folder_idx", "method"), FOLDER_KEY
        )
        going = condition & ~in_trash & F.col("method").isNotNull()
        to_trash = F.coalesce(going & trashing, F.lit(False))
        flagged = tr.flag_deleted(known, F.coalesce(going & ~trashing, F.lit(False))).withColumn(
            "_moved_at", F.when(to_trash, F.col("folder_idx"))
        ).drop("folder_idx")
        has_trash = not allowed.filter(trashing).isEmpty()
        moved = flagged
        if has_trash:
            moved = tr.gmail_trash(flagged, F.col("_moved_at").isNotNull(), self.last_uids)
            self.moved = True

        trash_units = allowed.filter(in_trash).drop("folder", "host", "command_idx")
        again = attach(moved.drop("method").filter(in_trash), trash_units, ["account"])
        in_time = F.col("_moved_at").isNull() | (F.col("_moved_at") < F.col("folder_idx"))
        hit = F.coalesce(condition & in_time & F.col("method").isNotNull(), F.lit(False))
        again = again.withColumn(
            "status", F.when(hit, F.when(trashing, "trashed").otherwise("deleted"))
        )
        again = again.withColumn("deleted", F.col("deleted") | (hit & ~trashing)).withColumn(
            "labels",
            F.when(hit & trashing, F.array_union("labels", F.array(F.lit(TRASH_LABEL))))
            .otherwise(F.col("labels")),
        )
        rest = moved.filter(~in_trash).select(*columns)
        stored = materialise(
            rest.unionByName(again.select(*columns, "account_idx", "folder_idx", "status"),
                             allowMissingColumns=True),
            "messages",
        )
        self.record(stored.filter("status is not null"), idx, "delete")
        self.set_messages(stored.select(*columns))
        if has_trash:  # the folder may be emptied when it is closed
            self.last_uids = materialise(tr.last_uids(stored, self.last_uids), "last-uids")

    def result(self) -> Result:
        counts = None
        for part in self.counts:
            counts = part if counts is None else counts.unionByName(part)
        messages = self.box.messages
        if self.inline is not None:
            messages = self.inline.with_content(messages)
        return Result(messages, self.outcomes(), counts, self.last_uids)

    def undo_later_accounts(self) -> None:
        """Accounts after the one a run ended at were never reached."""
        later = self.box.accounts.filter(F.col("account_idx") > self.run_stop).select("account")
        columns = self.box.messages.columns
        reached = attach(self.box.messages, later, ["account"], "left_anti").select(*columns)
        untouched = attach(self.start, later, ["account"], "left_semi").select(*columns)
        self.set_messages(materialise(reached.unionByName(untouched), "messages"))
        path = scratch_path(self.spark, "outcomes-reached")
        self.outcomes().filter(F.col("account_idx") <= self.run_stop).write.parquet(path)
        self.outcome_paths = [path]


def run_pipeline(
    box: Mailbox,
    commands: Sequence[Command | None],
    now: dt.datetime | int,
    cycle_id: int = 0,
    folders: FolderChoice | None = None,
) -> Result:
    """Run commands in order; each sees what the ones before it did.

    Raises ``CatastrophicFailure``, which carries the result so far, when a
    paranoid fetch ends the run.
    """
    run = _Run(box, cycle_id, to_ns(now))
    for idx, command in enumerate(prepare(commands, folders)):
        run.run(idx, command)
        if run.run_stop is not None:
            # Earlier accounts still get their remaining commands; the account
            # itself and later ones do not.
            run.stopped = (
                box.accounts.filter(F.col("account_idx") >= run.run_stop).select("account")
                if run.stopped is None
                else run.stopped.union(
                    box.accounts.filter(F.col("account_idx") >= run.run_stop).select("account")
                ).distinct()
            )
    if run.run_stop is not None:
        run.undo_later_accounts()
        raise CatastrophicFailure(run.result())
    return run.result()


def fetch(box: Mailbox, command: Fetch, now: dt.datetime | int, cycle_id: int = 0) -> Result:
    """One fetch: select, batch, deliver, judge, and mark only what arrived."""
    return run_pipeline(box, [command], now, cycle_id)


def dry_run_lines(
    counts: DataFrame, command: Command, now: dt.datetime | int, accounts: DataFrame | None = None
) -> DataFrame:
    """``dry-run: not …`` lines for a command whose counts were taken.

    For an automatic delete, ``accounts`` tells where mail would be moved to the trash.
    """
    text = command.effective_filter().bind(now).render()
    rows = counts.filter(F.col("command") == command.kind)
    if command.kind == "delete":
        rows = tr.resolve_delete_method(rows, accounts, command.method) if accounts is not None else (
            rows.withColumn("method", F.lit(command.method)))
        verb = F.when(F.col("method") == "gmail-trash", "moving").otherwise("deleting")
        where = F.when(F.col("method") == "gmail-trash", F.lit(f" to `{TRASH_FOLDER}`")).otherwise("")
    else:
        verb = F.lit("fetching" if command.kind == "fetch" else f"marking as {(command.mark_name() or '').upper()}")
        where = F.lit("")
    return rows.select(
        "account_idx", "folder_idx",
        F.format_string(
            "dry-run: not %s %d messages matching %s from folder `%s`%s",
            verb, F.col("n"), F.lit(text), F.col("folder"), where,
        ).alias("line"),
    )
