"""Delivery of message content, and what each delivery result means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.content import (
    binary_newlines,
    message_hash,
    message_length,
    normalise_newlines,
)
from lettermill.functions.text import plural
from lettermill.operators.ranking import UID_BLOCK, number_rows
from lettermill.schema import MESSAGE_KEY
from lettermill.session import materialise, scratch_path, ship_package

MODES = ("yolo", "careful", "paranoid")
DELIVERED = ("delivered", "marked", "delivered_unmarked")

_UNIT = ["account_idx", "account", "command_idx", "folder_idx", "folder", "batch_id"]
_BATCH_KEY = ["account", "command_idx", "folder", "batch_id"]
_IN_ACCOUNT = ["command_idx", "folder_idx", "batch_id"]
_IN_RUN = ["account_idx", *_IN_ACCOUNT]

# batches that one task of a careful or paranoid delivery hands over at most
RUN_BATCHES = 64
# how many times as many waves are laid out each time
_MORE_WAVES = 16

ABORTED = (
    "nothing of a batch was delivered: the rest of this fetch and later commands of the account are left out"
)


def clean_content(rows: DataFrame) -> DataFrame:
    """Normalise header and body apart, add ``msg_hash`` and ``length``."""
    kinds = dict(rows.dtypes)
    for part in ("header", "body"):
        fix = binary_newlines if kinds[part] == "binary" else normalise_newlines
        rows = rows.withColumn(part, fix(F.col(part)))
    parts = (F.col("header"), F.col("body"))
    return rows.withColumn("msg_hash", message_hash(*parts)).withColumn(
        "length", message_length(*parts)
    )


def deliver(rows: DataFrame, fn: Callable[[bytes, str], object]) -> DataFrame:
    """Hand each message to ``fn(raw, msg_hash)``; returns key, ``ok``, ``detail``.

    A message is delivered when ``fn`` returns nothing, True or 0; any other
    value or an exception fails that message only.  Spark may repeat a task, so
    ``fn`` can see a message twice: the hash is its idempotency key.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [
                _handed(fn, header, body, digest)
                for header, body, digest in zip(batch["header"], batch["body"], batch["msg_hash"])
            ]
            out = batch[MESSAGE_KEY].copy()
            out["ok"] = [ok for ok, _ in results]
            out["detail"] = [detail for _, detail in results]
            yield out

    return rows.select(*MESSAGE_KEY, "msg_hash", *_raw()).mapInPandas(run, _RESULT)


_RESULT = "account string, folder string, uid bigint, ok boolean, detail string"
_HANDED = ("account_idx int, account string, folder_idx int, folder string, batch_id bigint, uid bigint, "
           "ok boolean, detail string")


def _raw() -> list[Column]:
    return [F.col(part).cast("binary").alias(part) for part in ("header", "body")]


def _handed(fn: Callable[[bytes, str], object], header, body, digest) -> tuple[bool, str | None]:
    try:
        code = fn(bytes(header) + bytes(body), digest)
        ok = code is None or code is True or (code == 0 and code is not False)
        return ok, None if ok else f"exit code {code!r}"
    except Exception as exc:  # the user's code may fail in any way
        return False, f"{type(exc).__name__}: {exc}"


def deliver_in_turn(
    rows: DataFrame, fn: Callable[[bytes, str], object], mode: str, run_batches: int = RUN_BATCHES,
    content_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """As :func:`deliver`, but nothing is handed over after a stop.

    A careful or paranoid delivery may not try a batch before it knows how the one before
    it went.  It therefore goes in waves: in each, one task hands over the next few batches of
    an account, one after another, and stops there by itself; between waves the results are
    judged, and accounts that ended take no further part.  A task never has more than
    ``run_batches`` batches, however large the account is, and a lost executor costs a wave.

    Careful: accounts go side by side.  Paranoid: a batch that is delivered in part ends the
    whole run, so all accounts form one line, in order, and a wave is one task.

    ``rows`` has ``account_idx``, ``folder_idx`` and ``batch_id`` besides the content; what is
    not handed over is not among the results.  With ``content_of`` it has no content: that is
    asked for by message key, for the first wave, then for some and for ever more of the waves
    that follow, so what comes after a stop is hardly read, and all of it in a few passes.
    """
    spark = rows.sparkSession
    ship_package(spark)
    batch = ["account_idx", "account", "folder_idx", "folder", "batch_id"]
    line = ["account"] if mode == "careful" else ["_line"]
    content = ["msg_hash", "header", "body"]
    given = ["msg_hash", *_raw()] if content_of is None else []
    rows = rows.select(*batch, "uid", *given, F.lit(0).alias("_line"))
    places = _batch_places(rows.select(*batch, "_line").distinct(), line)
    places = places.select(*batch, F.expr(f"_place div {run_batches}").alias("_wave"))
    placed = rows.join(places, batch)
    if content_of is not None:
        placed = materialise(placed, "turns")
        places = placed

    def lay_out(first: int, end: int) -> DataFrame:
        """Content by wave, so that each wave reads its own folder only."""
        laid_at = scratch_path(spark, "waves")
        dealt = placed
        if content_of is not None:
            next_ones = placed.filter(F.col("_wave").between(first, end - 1))
            if ended is not None:
                next_ones = next_ones.join(ended, "account", "left_anti")
            found = content_of(next_ones.select(*MESSAGE_KEY))
            dealt = next_ones.join(found.select(*MESSAGE_KEY, "msg_hash", *_raw()), MESSAGE_KEY)
        dealt = dealt.select(*batch, "uid", *content, "_line", "_wave").repartition("_wave", *line)
        dealt.write.partitionBy("_wave").parquet(laid_at)
        return spark.read.schema(dealt.schema).parquet(laid_at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, unit, good, bad, ended, over = None, None, 0, 0, False, False
        for part in batches:
            results = []
            for row in part.itertuples(index=False):
                now = (row.account, row.folder_idx, row.folder, row.batch_id)
                if now != unit:
                    if bad:
                        ended = ended or good == 0
                        over = over or (good > 0 and mode == "paranoid")
                    if row.account != account:
                        account, ended = row.account, False
                    unit, good, bad = now, 0, 0
                if ended or over:
                    continue
                ok, detail = _handed(fn, row.header, row.body, row.msg_hash)
                good, bad = good + ok, bad + (not ok)
                results.append((row.account_idx, row.account, row.folder_idx, row.folder, row.batch_id,
                                row.uid, ok, detail))
            yield pd.DataFrame(results, columns=[*batch, "uid", "ok", "detail"])

    results, ended = None, None
    waves = (places.agg(F.max("_wave")).first()[0] or 0) + 1
    laid, laid_upto = None, 0
    for wave in range(waves):
        if wave == laid_upto:
            laid_upto = waves if content_of is None else min(waves, max(1, wave * _MORE_WAVES))
            laid = lay_out(wave, laid_upto)
        turn = laid.filter(F.col("_wave") == wave)
        if ended is not None:
            turn = turn.join(ended, "account", "left_anti")
        turn = turn.select(*batch, "uid", "msg_hash", "header", "body", "_line")
        dealt = turn.repartition(*line).sortWithinPartitions(*batch, "uid").drop("_line")
        done = materialise(dealt.mapInPandas(run, _HANDED), "wave")
        results = done if results is None else results.unionByName(done)
        per = done.groupBy("account", "folder", "batch_id").agg(
            F.count_if("ok").alias("d"), F.count_if(~F.col("ok")).alias("u")).filter("u > 0")
        if mode == "paranoid" and not per.filter("d > 0").isEmpty():
            break
        stopped = per.filter("d = 0").select("account").distinct()
        if not stopped.isEmpty():
            stopped = materialise(stopped, "ended")
            ended = stopped if ended is None else ended.unionByName(stopped)
    return results.select(*MESSAGE_KEY, "ok", "detail")


def _batch_places(batches: DataFrame, line: list[str]) -> DataFrame:
    """Add ``_place``: the position of each batch in its line, counted in blocks of folders and numbers."""
    blocked = batches.withColumn("_block", F.expr(f"batch_id div {UID_BLOCK}"))
    return number_rows(blocked, line, [["account_idx", "account"], ["folder_idx", "folder"], ["_block"]],
                       ["batch_id"], "_place")


def batch_summary(deliveries: DataFrame) -> DataFrame:
    """Delivered (``d``) and failed (``u``) messages per batch.

    A null ``ok`` is a conflict: neither delivered nor failed.
    """
    return deliveries.groupBy(*_UNIT).agg(
        F.count_if(F.col("ok")).alias("d"), F.count_if(~F.col("ok")).alias("u")
    )


def judge_batches(batches: DataFrame, mode: str) -> DataFrame:
    """Add ``late`` (after a stop), ``stops`` and ``spoiled`` to batch rows.

    Stops are found as minima over the order of batches, which need no sorting
    and no window: per account for a batch that delivered nothing, and for the
    whole run, in paranoid mode, for one that delivered a part.
    """
    if mode not in MODES:
        raise ValueError(f"delivery mode must be one of {MODES}")
    failing = F.col("u") > 0
    empty = failing & (F.col("d") == 0)
    if mode == "yolo":
        no = F.lit(False)
        return batches.select("*", no.alias("late"), no.alias("stops"), no.alias("spoiled"))
    position = F.struct(*_IN_ACCOUNT)
    stops = batches.filter(empty).groupBy("account").agg(F.min(position).alias("_stop"))
    judged = batches.join(stops, "account", "left").withColumn(
        "late", F.coalesce(position > F.col("_stop"), F.lit(False))
    )
    partial = failing & (F.col("d") > 0)
    if mode == "paranoid":
        run_position = F.struct(*_IN_RUN)
        run_stop = judged.filter(partial & ~F.col("late")).agg(F.min(run_position)).scalar()
        judged = judged.withColumn(
            "late", F.col("late") | F.coalesce(run_position > run_stop, F.lit(False))
        )
    return judged.drop("_stop").select(
        "*",
        (empty & ~F.col("late")).alias("stops"),
        (partial & ~F.col("late") if mode == "paranoid" else F.lit(False)).alias("spoiled"),
    )


def delivery_outcome(
    deliveries: DataFrame, mode: str = "careful", marking: bool = True
) -> DataFrame:
    """Add ``status`` to delivery rows (``ok`` true, false, or null for conflicts)."""
    judged = judge_batches(batch_summary(deliveries), mode).select(*_BATCH_KEY, "late", "spoiled")
    good = F.when(F.col("spoiled"), "delivered_unmarked").otherwise(
        "marked" if marking else "delivered"
    )
    status = (
        F.when(F.col("late"), "not_attempted")
        .when(F.col("ok").isNull(), "conflict")
        .when(F.col("ok"), good)
        .otherwise("failed")
    )
    return (
        deliveries.join(judged, _BATCH_KEY)
        .withColumn("status", status)
        .drop("late", "spoiled")
    )


def delivery_errors(judged: DataFrame, target: str) -> DataFrame:
    """Error rows of batches: one per failing batch, one more per stop."""
    failed = plural(F.col("u"), f"%d message not delivered to `{target}`", f"%d messages not delivered to `{target}`")
    details = F.array_compact(F.array(failed, F.when(F.col("stops"), F.lit(ABORTED))))
    return judged.filter((F.col("u") > 0) & ~F.col("late")).select(
        *_UNIT, F.explode(details).alias("detail")
    ).withColumn("status", F.lit("error"))


def missing_responses(requested: DataFrame, returned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(undelivered rows, one error row per chunk) for incomplete answers.

    One UID without an answer makes its whole request chunk undelivered.
    """
    chunk = ["account", "folder", "chunk"]
    broken = (
        requested.join(returned.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
        .select(*chunk)
        .distinct()
    )
    undelivered = requested.join(broken, chunk, "left_semi").withColumn("status", F.lit("failed"))
    errors = broken.withColumn("status", F.lit("error")).withColumn(
        "detail", F.lit("a request was not answered for all of its messages")
    )
    return undelivered, errors


def conflicts(responses: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, conflict rows) by whether all ``required`` columns are there."""
    complete: Column = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    bad = responses.filter(~complete).withColumn("status", F.lit("conflict")).withColumn(
        "detail",
        F.lit("the message was changed or removed by someone else meanwhile"),
    )
    return responses.filter(complete), bad
