"""Size-limited batches.

Packing is a running decision: whether a message joins the open batch depends
on everything packed before it in its folder.  To keep one huge folder from
becoming one task, a folder is divided into segments of whole chunks that are
packed at the same time.

How a segment starts depends on the open batch the one before it leaves.  That
is not known, but there are few possibilities: packed from many different open
batches, a segment ends in a handful of ways, because packings that once agree
agree ever after.  Each segment is packed from all ends found for the one
before it.  One walk over the segments then links starts to ends.  An end that
was not foreseen is packed again from its real start, until none is left, so
the outcome is exactly that of packing the folder from front to end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.operators.ranking import number_in_folder
from lettermill.schema import BATCH_NUMBER, BATCH_SIZE, FETCH_NUMBER
from lettermill.session import materialise, ship_package

_SEGMENT_ROWS = 150_000
_PROBES = 64
_SEGMENT = ["account", "folder", "segment"]
_PACKED = (
    "account string, folder string, segment bigint, start_n bigint, start_bytes bigint, "
    "end_n bigint, end_bytes bigint, closed bigint"
)
_SHAPE = _PACKED + (
    ", rows bigint, one_size bigint, in_order boolean, head array<bigint>, tail array<bigint>, "
    "ends array<struct<n:bigint,size:bigint>>"
)
_PLAN = (
    "account string, folder string, segment bigint, start_n bigint, start_bytes bigint, "
    "first_batch bigint, known boolean"
)


class Packer:
    """Packs messages of one folder; at most one batch is open at a time."""

    def __init__(self, limit_n: int, limit_bytes: int, n: int = 0, size: int = 0):
        self.limit_n, self.limit_bytes = limit_n, limit_bytes
        self.n, self.size, self.closed = n, size, 0

    def _close(self) -> None:
        self.n, self.size = 0, 0
        self.closed += 1

    def add_chunk(self, sizes: list[int], labels: np.ndarray, at: int) -> None:
        """Pack one chunk; write batch ordinals to ``labels`` from ``at`` on."""
        waiting = range(len(sizes))
        while waiting:
            passed_over = []
            for i in waiting:
                grown = self.size + sizes[i]
                if self.n < self.limit_n and grown < self.limit_bytes:
                    labels[at + i] = self.closed
                    self.n, self.size = self.n + 1, grown
                else:
                    passed_over.append(i)
            if passed_over:
                if self.n == 0:  # nothing fits an empty batch: it travels alone
                    labels[at + passed_over.pop(0)] = self.closed
                self._close()
            waiting = passed_over
        if self.n == self.limit_n:  # full: nothing can join any more
            self._close()


def _pack(sizes: np.ndarray, n: int, size: int, chunk_n: int, max_n: int, max_bytes: int):
    packer = Packer(max_n, max_bytes, n, size)
    labels = np.empty(len(sizes), dtype=np.int64)
    for at in range(0, len(sizes), chunk_n):
        packer.add_chunk(sizes[at : at + chunk_n].tolist(), labels, at)
    return packer, labels


def _pack_from_many(
    sizes: np.ndarray, starts: list[tuple[int, int]], chunk_n: int, max_n: int, max_bytes: int
) -> list[tuple[int, int, int]]:
    """(n, bytes, closed batches) at the end, for each open batch at the start.

    Packings that have come to the same open batch go on as one.
    """
    state, closed = list(starts), [0] * len(starts)
    scratch = np.empty(chunk_n, dtype=np.int64)
    for at in range(0, len(sizes), chunk_n):
        chunk = sizes[at : at + chunk_n].tolist()
        after: dict[tuple[int, int], tuple[tuple[int, int], int]] = {}
        for i, before in enumerate(state):
            if before not in after:
                packer = Packer(max_n, max_bytes, *before)
                packer.add_chunk(chunk, scratch, 0)
                after[before] = (packer.n, packer.size), packer.closed
            state[i] = after[before][0]
            closed[i] += after[before][1]
    return [(n, size, c) for (n, size), c in zip(state, closed)]


def _likely_ends(sizes: np.ndarray, chunk_n: int, max_n: int, max_bytes: int):
    """The ways a segment ends when it starts with more or less full batches."""
    usual = min(max_n, max_bytes / max(1.0, float(sizes.mean())))
    starts = [
        (int(usual * k / _PROBES), max_bytes * k // _PROBES if usual * k >= _PROBES else 0)
        for k in range(_PROBES)
    ]
    ends = _pack_from_many(sizes, starts, chunk_n, max_n, max_bytes)
    return [{"n": n, "size": size} for n, size in sorted({(n, size) for n, size, _ in ends})]


def _shape(sizes: np.ndarray, max_n: int, max_bytes: int):
    """What a segment does when only the count limit ever binds.

    ``in_order`` says that no ``max_n`` consecutive messages reach the byte
    limit; then packing is plain counting, and the segment's effect on *any*
    open batch follows from the sums over its first and last messages.
    """
    rows = len(sizes)
    sums = np.concatenate(([0], np.cumsum(sizes)))
    in_order = rows >= max_n and bool((sums[max_n:] - sums[:-max_n] < max_bytes).all())
    if not in_order:
        return False, [], []
    return True, sums[: max_n + 1].tolist(), (sums[-1] - sums[::-1][:max_n]).tolist()


def _end_of_equals(n: int, size: int, rows: int, each: int, max_n: int, max_bytes: int):
    """Where packing ``rows`` messages of one size ends, by division.

    Many copies of one message make such segments; from different open batches
    they never come to the same end, so packing them again would not help.
    """

    def fitting(used: int) -> int:
        return rows if each == 0 else (max_bytes - 1 - used) // each

    per_batch = min(max_n, fitting(0))
    if per_batch == 0:  # too large for any batch: each travels alone
        return 0, 0, rows + (n > 0)
    joining = min(rows, max_n - n, fitting(size))
    rest = rows - joining
    closed, n, size = 0, n + joining, size + joining * each
    if rest:
        closed = (rest - 1) // per_batch + 1
        n = rest - (closed - 1) * per_batch
        size = n * each
    return (0, 0, closed + 1) if n == max_n else (n, size, closed)


def _follow(
    segments: pd.DataFrame, memo: dict, max_n: int, max_bytes: int
) -> Iterator[tuple]:
    """Carry the open batch over the segments of one folder, front to end."""
    n, size, first = 0, 0, 0
    for row in segments.itertuples(index=False):
        known_ends = memo[row.segment]
        end = known_ends.get((n, size))
        known = True
        if end is None and row.in_order and size + row.head[max_n - n] < max_bytes:
            total = n + row.rows
            left = total % max_n
            end = (left, int(row.tail[left]), total // max_n)
        if end is None and row.one_size >= 0:
            end = _end_of_equals(n, size, row.rows, row.one_size, max_n, max_bytes)
        if end is None:
            known = False
            end = next(reversed(known_ends.values()))  # likely: same end from any start
        yield row.segment, n, size, first, known
        n, size, first = end[0], end[1], first + end[2]


def size_batches(
    messages: DataFrame,
    chunk_n: int = FETCH_NUMBER,
    max_n: int = BATCH_NUMBER,
    max_bytes: int = BATCH_SIZE,
    segment_rows: int = _SEGMENT_ROWS,
) -> DataFrame:
    """(account, folder, uid, size, batch_id) by greedy packing in UID order.

    A message joins the open batch while that has fewer than ``max_n`` messages
    and stays *below* ``max_bytes``; others wait for the next batch of their
    chunk.  A message that fits no empty batch travels alone.  An open batch is
    carried into the next chunk.  Batch ids follow the order of closing.
    """
    spark = messages.sparkSession
    ship_package(spark)
    # Segments of whole chunks and whole batches keep pure counting in step.
    unit = math.lcm(chunk_n, max_n)
    span = max(1, segment_rows // unit) * unit
    rows = materialise(
        number_in_folder(messages.select("account", "folder", "uid", "size"))
        .withColumn("segment", F.expr(f"position div {span}")),
        "batch-rows",
    )

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("uid")["size"].to_numpy()
        packer, _ = _pack(sizes, 0, 0, chunk_n, max_n, max_bytes)
        in_order, head, tail = _shape(sizes, max_n, max_bytes)
        one_size = int(sizes[0]) if (sizes == sizes[0]).all() else -1
        ends = []
        if len(sizes) == span and not in_order and one_size < 0:
            ends = _likely_ends(sizes, chunk_n, max_n, max_bytes)
        return pd.DataFrame(
            [(*pdf[_SEGMENT].iloc[0], 0, 0, packer.n, packer.size, packer.closed,
              len(sizes), one_size, in_order, head, tail, ends)],
            columns=[f.split()[0] for f in _SHAPE.split(", ")],
        )

    def repack(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in _PACKED.split(", ")]
        if pdf.empty or starts.empty:
            return pd.DataFrame(columns=columns)
        sizes = pdf.sort_values("uid")["size"].to_numpy()
        given = list(zip(starts["start_n"].tolist(), starts["start_bytes"].tolist()))
        ends = _pack_from_many(sizes, given, chunk_n, max_n, max_bytes)
        where = tuple(pdf[_SEGMENT].iloc[0])
        return pd.DataFrame(
            [(*where, *start, *end) for start, end in zip(given, ends)], columns=columns
        )

    def try_starts(starts: DataFrame, label: str) -> DataFrame:
        wanted = rows.join(starts.select(*_SEGMENT).distinct(), _SEGMENT, "left_semi")
        packed = (
            wanted.groupBy(*_SEGMENT).cogroup(starts.groupBy(*_SEGMENT)).applyInPandas(repack, _PACKED)
        )
        return materialise(packed, label)

    def plan(shapes: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        memo: dict = {}
        for t in tried.itertuples(index=False):
            memo.setdefault(t.segment, {})[(t.start_n, t.start_bytes)] = (
                t.end_n, t.end_bytes, t.closed,
            )
        steps = list(_follow(shapes.sort_values("segment"), memo, max_n, max_bytes))
        out = pd.DataFrame(
            steps, columns=["segment", "start_n", "start_bytes", "first_batch", "known"]
        )
        out.insert(0, "folder", shapes["folder"].iloc[0])
        out.insert(0, "account", shapes["account"].iloc[0])
        return out

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        n, size = int(pdf["start_n"].iloc[0]), int(pdf["start_bytes"].iloc[0])
        _, labels = _pack(pdf["size"].to_numpy(), n, size, chunk_n, max_n, max_bytes)
        pdf["batch_id"] = labels + int(pdf["first_batch"].iloc[0])
        return pdf[["account", "folder", "uid", "size", "batch_id"]]

    shapes = materialise(rows.groupBy(*_SEGMENT).applyInPandas(shape, _SHAPE), "batch-shapes")

    def link_segments() -> DataFrame:
        tried = shapes.select(*[f.split()[0] for f in _PACKED.split(", ")])
        foreseen = shapes.select(
            "account", "folder", (F.col("segment") + 1).alias("segment"), F.inline("ends")
        ).withColumnsRenamed({"n": "start_n", "size": "start_bytes"})
        if not foreseen.isEmpty():
            tried = tried.unionByName(try_starts(foreseen, "batch-tries"))
        while True:
            # One small row per segment: a folder of 10^9 messages has some 7,000.
            plans = materialise(
                shapes.groupBy("account", "folder")
                .cogroup(tried.groupBy("account", "folder"))
                .applyInPandas(plan, _PLAN),
                "batch-plan",
            )
            wrong = plans.filter(~F.col("known"))
            if wrong.isEmpty():
                return plans
            tried = tried.unionByName(
                try_starts(wrong.select(*_SEGMENT, "start_n", "start_bytes"), "batch-retry")
            )

    if shapes.filter("segment > 0").isEmpty():  # no folder has more than one segment
        plans = shapes.select(
            *_SEGMENT, "start_n", "start_bytes", F.lit(0).cast("bigint").alias("first_batch")
        )
    else:
        plans = link_segments().drop("known")
    return (
        rows.join(plans, _SEGMENT)
        .groupBy(*_SEGMENT)
        .applyInPandas(
            label, "account string, folder string, uid bigint, size bigint, batch_id bigint"
        )
    )


def batch_totals(batches: DataFrame, by: str = "batch_id") -> DataFrame:
    """Messages and bytes per batch."""
    return batches.groupBy("account", "folder", by).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes")
    )
