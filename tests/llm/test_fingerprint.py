import hashlib

import numpy as np
from pyspark.sql import functions as F
from tables import no_docs, odd_docs

import __spark_entry__ as entry
from lettermill.llm import fingerprint
from lettermill.llm.fingerprint import BINS, code_hex, edited_likeness, fingerprints, likeness, packed_codes

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_against_exact_resemblance(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op7_fingerprints"](spark, SF).collect()}
    ids = sorted(docs, reverse=True)
    off = []
    for k, i in enumerate(ids):
        text, after = docs[i], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(shingles, (text, edited, after))
        off.append((row.near_edited - len(a & b) / len(a | b), row.near_next - len(a & c) / len(a | c)))
    off = np.array(off)
    assert np.abs(off.mean(axis=0)).max() < 0.02 and np.abs(off).max() < 0.25 and off.std(axis=0).max() < 0.06
    assert len(got) == len(docs)


def test_bins_by_hand(spark):
    """The same fingerprint from shingle hashes in plain Python."""
    from lettermill.llm.fingerprint import _probes

    texts = ["a b c d e f g h", "one", " ".join(f"w{k}" for k in range(700)), ""]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    hashed = {r.doc_id: r.h for r in frame.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("h")).collect()}
    starts, steps = _probes()
    got = {r.doc_id: r.fingerprint for r in fingerprints(frame).collect()}
    for k, text in enumerate(texts):
        h = hashed[k]
        if not h:
            assert got[k] == "0" * BINS
            continue
        rows = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else []
        one = spark.createDataFrame([(r,) for r in rows] or [(h,)], "h array<long>")
        value = F.xxhash64(*(F.col("h")[i] for i in range(5))) if rows else F.xxhash64("h")
        found = {}
        for v in (r.v & (2**64 - 1) for r in one.select(value.alias("v")).collect()):
            found[v >> 57] = min(found.get(v >> 57, 1 << 63), v >> 1)
        digits = ""
        for j in range(BINS):
            spot = next((p for p in [j, *((starts[j] + steps[j] * t) % BINS for t in range(BINS))] if p in found))
            digits += f"{found[spot] & 15:x}"
        assert got[k] == digits


def test_likeness_bounds(spark):
    texts = ["a b c d e f g", "a b c d e f g", "x y z u v w t s", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select(
        "k", packed_codes(F.col("text")).alias("c"))
    rows = frame.select("k", code_hex(F.col("c")).alias("f"), "c").alias("a").crossJoin(
        frame.alias("b")).orderBy("a.k", "b.k").select("a.f", likeness(F.col("a.c"), F.col("b.c")).alias("s")).collect()
    s = np.array([r.s for r in rows]).reshape(5, 5)
    assert (np.diag(s) == 1).all() and s[0, 1] == 1 and s[3, 4] == 1 and s[0, 3] == s[4, 0] == 0 and s[0, 2] < 0.25


def test_odd_tables(spark):
    docs = odd_docs(spark)
    got = edited_likeness(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert edited_likeness(no_docs(spark)).count() == 0
    lone = edited_likeness(docs.where("doc_id = 1")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_buckets_do_not_matter(spark):
    from lettermill.llm.fingerprint import with_next

    docs = spark.range(0, 4_000, 3).selectExpr("id as doc_id", "concat('t', id) as text")
    for rows in (10, 100, 5_000):
        got = {r.doc_id: r.next_doc_id for r in with_next(docs, {}, bucket_rows=rows).collect()}
        ids = sorted(got, reverse=True)
        assert got == {a: b for a, b in zip(ids, [*ids[1:], ids[0]])}


def test_hot_ids_and_many_equal_rows(spark, monkeypatch):
    """Ids and nulls with more rows than a bucket should have, some of them equal."""
    rows = [(k, f"text {k}") for k in range(20)]
    rows += [(7, f"seven {k}") for k in range(9)] + [(7, "seven again and again")] * 7 + [(3, f"three {k}") for k in range(5)]
    rows += [(None, f"none {k}") for k in range(8)] + [(None, "nothing but nothing")] * 6 + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    ring = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -hashed[r[1]]))
    want = []
    for k, (i, text) in enumerate(ring):
        after = ring[(k + 1) % len(ring)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for hot, bucket in ((50_000, 2_000), (3, 4), (1, 1), (4, 1_000)):
        monkeypatch.setattr(fingerprint, "HOT_ROWS", hot)
        found = fingerprint.with_next(docs, {}, bucket_rows=bucket)
        half = F.floor(F.length("text") / 2).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                          F.substring(F.col("next_text"), F.lit(1), half))
        got = found.select("doc_id", F.length("text").alias("n"), F.sha2(edited, 256).alias("sha")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), (hot, bucket)
