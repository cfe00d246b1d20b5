import math
import os

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tables import no_docs, odd_docs

import __spark_entry__ as entry
from lettermill.llm import mixing
from lettermill.llm.mixing import mix, mixed_rows, source_targets
from lettermill.llm.ordering import number_in_order

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    db = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        db.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    got = entry.queries()["op8_source_mix"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = db.execute(entry.oracle_sql()["op8_source_mix"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        held = sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        part = {s: (total - held) * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if part[s] > most * sizes[s]}
        if not over:
            return part | {s: most * sizes[s] for s in full}
        full |= over


def test_targets(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        sizes = {f"s{k}" if k else None: int(rng.integers(0, 1000)) for k in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(table, (5, 2, 1), 1.5, 2.0).collect()}
        want = plain_targets(sizes, (5, 2, 1), 1.5, 2.0)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)


def test_order_of_keys_and_ranges(spark, monkeypatch):
    rows = [(k, f"s{k % 2}", " ".join(["w"] * (k % 7 + 1))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weight = spark.createDataFrame([(k, [0.5, 8.0, 0.0, -1.0, math.nan][k % 5]) for k in range(0, 400, 2)],
                                   "doc_id long, weight double")
    picks = {}
    for ranges in (65_536, 7, 1):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        got = mix(docs, weight).collect()
        picks[ranges] = sorted((r.doc_id, r.copies) for r in got)
        for source in ("s0", "s1"):
            own = [r for r in got if r.source == source]
            taken, target = sum(r.copies * r.size for r in own), own[0].target
            assert abs(taken - target) <= 3.5 and max(r.copies for r in own) <= 2
            assert {r.source_size for r in own} == {sum(r.size for r in own)}
    assert picks[65_536] == picks[7] == picks[1]
    drawn = {r.doc_id: r.u for r in docs.select("doc_id", mixing.draw().alias("u")).collect()}
    heavy = {r.doc_id: r.weight for r in weight.collect()}
    s0 = sorted((k for k in range(0, 400, 2)), key=lambda k: -math.log(drawn[k]) / (heavy[k] if heavy[k] > 0 else 1.0))
    copies = [dict(picks[7])[k] for k in s0]
    assert copies == sorted(copies, reverse=True)  # those drawn first are taken once more


def test_odd_tables(spark):
    docs = odd_docs(spark)
    picks = mix(docs)
    assert picks.count() == docs.count() and picks.where("copies is null or target is null").count() == 0
    rows = mixed_rows(docs, picks)
    assert rows.columns == docs.columns
    assert rows.count() == picks.agg(F.sum("copies")).first()[0]
    assert mix(no_docs(spark)).count() == 0 and mixed_rows(no_docs(spark), mix(no_docs(spark))).count() == 0
    empty = docs.where("text is null or trim(text) = ''")
    assert {r.copies for r in mix(empty).collect()} <= {0, 1}


def test_numbers(spark):
    rows = spark.range(0, 1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = sorted((r.place, r.k) for r in number_in_order(rows, [F.col("k")]).collect())
    assert [p for p, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_empty_documents_are_not_taken_more_often_than_others(spark):
    """One source stops at twice its size: whole epochs only, also for what has no words."""
    rows = [(k, "a", "w w" if k % 3 else "") for k in range(12)] + [(100 + k, "b", "w " * 400) for k in range(9)]
    picks = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.copies for r in picks if r.source == "a"} == {2} and all(r.copies <= 2 for r in picks)
