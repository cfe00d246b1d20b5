import numpy as np
import pytest

import __spark_entry__ as entry
from lettermill.llm.onebit import build_index, encode, estimate, search, usable

SF = "/root/testdata/sf0.001"


def plain(vectors, queries, nearest):
    out = []
    for q, v in queries:
        near = sorted(((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in vectors
                       if i != q and len(w) == len(v)))[:nearest]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(near)]
    return out


def same(got, want):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12, atol=1e-12)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    guess, error = estimate(*encode(vectors), queries)
    off = queries @ vectors.T - guess
    assert (np.abs(off) <= error).mean() > 0.995 and abs(off.mean()) < 0.05 * np.abs(off).mean() + 0.05


def test_query_finds_what_all_pairs_find(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    want = plain(vectors, [v for v in vectors if v[0] % 20 == 0], 20)
    got = entry.queries()["op9_nearest_vectors"](spark, SF).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want) and len(found & {w[::2][:2] for w in want}) / len(want) > 0.9


@pytest.mark.parametrize("blocks", [(1_024, 16_384), (3, 10)])
def test_odd_vectors_and_ties(spark, blocks):
    rng = np.random.default_rng(6)
    good = [(k, [float(np.float32(x)) for x in rng.standard_normal(6)]) for k in range(60)]
    copies = [(200 + k, good[0][1]) for k in range(40)] + [(300 + k, [2 * x for x in good[1][1]]) for k in range(5)]
    short = [(400, [1.0]), (401, [2.0]), (402, [-1.0])]
    odd = [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, good[2][1]),
           (504, [float("nan")] * 6), (505, [float("inf")] + [0.0] * 5), good[3]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in good + copies + short + odd],
                                  "vec_id long, embedding array<float>, rank int, dim int")
    queries = usable(table, "vec_id", "embedding").where("vec_id in (0, 1, 3, 10, 205, 300, 400, 500)")
    got = search(build_index(table, 5), queries, 5, *blocks).collect()
    vectors = good + copies + short
    same(got, plain(vectors, [v for v in vectors if v[0] in (0, 1, 3, 10, 205, 300, 400)], 5))


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert search(build_index(table), usable(table, "vec_id", "embedding")).count() == 0
