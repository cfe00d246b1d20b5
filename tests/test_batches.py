import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.operators import batching, ranking
from lettermill.operators.batching import batch_totals, size_batches
from lettermill.operators.ranking import chunk, duplicate_number, number_in_folder

_SIZES = "account string, folder string, uid bigint, size bigint"


def packed_by_hand(sizes, chunk_n, max_n, max_bytes):
    """The packing rule stated plainly, front to end."""
    label, batch, n, total = {}, 0, 0, 0
    for start in range(0, len(sizes), chunk_n):
        queue = list(range(start, min(start + chunk_n, len(sizes))))
        while queue:
            behind = []
            for i in queue:
                if n < max_n and total + sizes[i] < max_bytes:
                    label[i], n, total = batch, n + 1, total + sizes[i]
                else:
                    behind.append(i)
            if not behind:
                break
            if n == 0:
                label[behind.pop(0)] = batch
            batch, n, total, queue = batch + 1, 0, 0, behind
    return [label[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes,limits,batches", [
    ([10, 20, 30], (150, 150, 100), [0, 0, 0]),
    ([60, 50, 30, 20], (150, 150, 100), [0, 1, 0, 1]),
    ([500, 10, 10], (150, 150, 100), [1, 0, 0]),
    ([50, 50], (150, 150, 100), [0, 1]),
    ([1] * 7, (150, 3, 100), [0, 0, 0, 1, 1, 1, 2]),
    ([60, 60, 60, 10], (2, 150, 100), [0, 1, 2, 1]),
    ([200, 300], (150, 150, 100), [0, 1]),
    ([90, 5, 90, 5], (2, 150, 100), [0, 0, 1, 1]),
])
def test_vectors(spark, sizes, limits, batches):
    assert packed_by_hand(sizes, *limits) == batches
    df = spark.createDataFrame([("a", "f", i, s) for i, s in enumerate(sizes)], _SIZES)
    got = size_batches(df, *limits).orderBy("uid").collect()
    assert [r.batch_id for r in got] == batches


@pytest.mark.parametrize("limits", [(6, 4, 100), (5, 3, 60), (4, 6, 90), (10, 10, 300)])
def test_segments_change_nothing(spark, limits):
    """Folders divided into many segments are packed as if they were not."""
    rnd = random.Random(sum(limits))
    kinds = [
        lambda i: rnd.randint(1, limits[2] * 2 // 3),
        lambda i: 3,
        lambda i: rnd.choice([1, 1, 1, 1, 1, limits[2] + 20]),
        lambda i: rnd.randint(limits[2] // 2, limits[2] - 1) if i < 5 else 2,
        lambda i: limits[2] // 4 if (i // 50) % 2 else 1,
        lambda i: limits[2] // 3,
        lambda i: limits[2] + 5 if 80 < i < 190 else 7,
        lambda i: limits[2] // 3 if i > 7 else 0,
    ]
    rows, want = [], {}
    for f in range(16):
        sizes = [kinds[f % 8](i) for i in range(rnd.randint(1, 300))]
        for i, b in enumerate(packed_by_hand(sizes, *limits)):
            rows.append(("a", f"f{f}", i * 7, sizes[i]))
            want["a", f"f{f}", i * 7] = b
    df = spark.createDataFrame(rows, _SIZES)
    got = size_batches(df, *limits, segment_rows=40)
    assert {(r.account, r.folder, r.uid): r.batch_id for r in got.collect()} == want
    over = batch_totals(got).filter(
        (F.col("messages") > 1) & ((F.col("messages") > limits[1]) | (F.col("bytes") >= limits[2]))
    )
    assert over.count() == 0


def test_equal_sizes_by_division():
    rnd = random.Random(11)
    for _ in range(3000):
        max_n, max_bytes, each = rnd.randint(1, 6), rnd.randint(1, 60), rnd.randint(0, 70)
        chunk_n, rows = rnd.randint(1, 9), rnd.randint(1, 60)
        n = rnd.randint(0, max_n - 1)
        size = rnd.randint(0, max_bytes - 1) if n else 0
        packer, _ = batching._pack(np.full(rows, each), n, size, chunk_n, max_n, max_bytes)
        assert batching._end_of_equals(n, size, rows, each, max_n, max_bytes) == (
            packer.n, packer.size, packer.closed), (n, size, rows, each, max_n, max_bytes)


def test_positions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "UID_BLOCK", 8)
    rnd = random.Random(3)
    uids = {f: sorted(rnd.sample(range(1000), n)) for f, n in (("x", 300), ("y", 1), ("z", 40))}
    df = spark.createDataFrame([("a", f, u, 1) for f, us in uids.items() for u in us], _SIZES)
    got = {(r.folder, r.uid): r.position for r in number_in_folder(df).collect()}
    assert got == {(f, u): i for f, us in uids.items() for i, u in enumerate(us)}
    chunks = {(r.folder, r.uid): r.chunk for r in chunk(df, 7).collect()}
    assert chunks == {k: i // 7 for k, i in got.items()}


@pytest.mark.parametrize("hot", [1, 5, 1 << 16])
def test_duplicate_numbers(spark, monkeypatch, hot):
    """A crowded content is numbered by blocks, with the same result."""
    monkeypatch.setattr(ranking, "UID_BLOCK", 4)
    monkeypatch.setattr(ranking, "ACCOUNT_BLOCK", 2)
    rnd = random.Random(5)
    keys = [(a, f, u) for a in range(5) for f in range(3) for u in rnd.sample(range(200), 12)]
    rows = [(*k, f"{k[0]}", f"{k[1]}", "h0" if i % 3 == 0 else f"h{i % 40}")
            for i, k in enumerate(keys)]
    schema = "account_idx int, folder_idx int, uid bigint, account string, folder string, msg_hash string"
    df = spark.createDataFrame(rows, schema)
    archive = spark.createDataFrame([("h0", 6), ("h0", 2), ("h7", 0)], "msg_hash string, dup_no bigint")
    want, base = {}, {"h0": 7, "h7": 1}
    for row in sorted(rows):
        want[row[:3]] = base.get(row[5], 0)
        base[row[5]] = want[row[:3]] + 1
    got = duplicate_number(df, archive, hot=hot)
    assert {(r.account_idx, r.folder_idx, r.uid): r.dup_no for r in got.collect()} == want
