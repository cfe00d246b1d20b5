import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm.centroids import cluster, hashed_start, kept, pack, unpack, whole, with_inertia

SCHEMA = "vec_id long, embedding array<double>, block int, cluster int, x string, distance double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dim, scale):
    """Lloyd over whole vectors in Python numbers."""
    def is_good(v):
        return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)

    def exact(x):
        top, bottom = float(x).as_integer_ratio()
        return scale * top // bottom

    vecs = [(i, [exact(x) for x in v], v) for i, v in rows if is_good(v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v, x) for i, x, v in vecs if i is not None)[:k]
    means = [x for _, _, _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x, _ in vecs]
        for c in range(len(means)):
            mine = [x for (_, x, _), o in zip(vecs, of) if o == c]
            if mine:
                means[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, nearest(x)[1], nearest(x)[0]) for i, x, _ in vecs] if means else []
    per = {c: sum(d for _, o, d in found if o == c) for c in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(d), fits(per[c]), fits(sum(per.values())), sha[c]) for i, c, d in found), key=str)


def run(spark, rows, k=4, rounds=3, dim=6, scale=64, **options):
    found, means = cluster(table(spark, rows), k, rounds, dim, scale, hashed_start(1), **options)
    return sorted((tuple(r) for r in with_inertia(found, means).collect()), key=str)


ODD = [(500, None), (501, []), (502, [1.0]), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6),
       (505, [float("inf")] + [0.0] * 5), (506, [0.0] * 7), (507, [0.0] * 6), (None, [0.5] * 6), (None, [0.5] * 6)]


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7, "block_columns": 4}, {"chunk_rows": 3, "block_columns": 1}])
def test_same_as_plain_lloyd(spark, options):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(80)]
    rows += ODD + rows[:5] + [(600 + k, rows[9][1]) for k in range(40)]  # repeated rows, many equal vectors
    assert run(spark, rows, **options) == plain(rows, 4, 3, 6, 64)


def test_huge_numbers_are_exact(spark):
    rows = [(k, [(-1.0) ** k * 1.7e10 * (k + 1), 0.3, k / 7, 3e38, 0.0, -1e-300]) for k in range(12)]
    rows += [(100 + k, [k / 3, 0.25, 1.0, -k / 9, 2.0**25 + k, 1e15]) for k in range(9)]
    want = plain(rows, 3, 2, 6, 64)
    assert any(r[2] is None for r in want) and run(spark, rows, 3, 2, block_columns=4) == want


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.0] * 6), (2, [1.0] * 6), (3, None)]
    assert run(spark, rows, 16) == plain(rows, 16, 3, 6, 64)
    assert run(spark, []) == [] and run(spark, [(None, [0.0] * 6)]) == []


def test_text_ids(spark):
    rows = table(spark, [(k, [k / 5] * 6) for k in range(20)]).withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    found, _ = cluster(rows, 2, 2, 6, 64, hashed_start(1))
    assert {r.vec_id for r in found.collect()} == {f"v{k}" for k in range(20)}


def test_packing_and_rounding():
    numbers = whole(np.array([[-0.01, 1.99], [3.5, -4.0]]), 64)
    assert numbers.tolist() == [[-1, 127], [224, -256]]
    for given in (numbers, numbers * 2**20, numbers * 2**40, whole(np.array([[1e300, -0.5]]), 64)):
        assert (unpack(pack(given), 2) == given).all()


def test_only_good_vectors_are_kept(spark):
    assert {r.vec_id for r in kept(table(spark, ODD), 6).collect()} == {507, None}
