"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle of five words is hashed once.  The highest bits of a hash say which of 128
bins it falls into; a bin keeps its smallest hash.  An empty bin takes the value of another
bin, found by a probe sequence of its own through all bins, so that two documents which
agree in the bins probed agree in what is borrowed.  Of each bin the four lowest bits are
kept, sixteen bins to a long.  Equal bins are counted on the packed longs, and the count is
corrected for bins that agree by chance.

All of it is built-in column functions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.textmap import whole_ids

SHINGLE_WORDS = 5
BINS = 128
BITS = 4
_PACKED = 64 // BITS
_LONGS = BINS // _PACKED
_BIN_SHIFT = 63 - int(math.log2(BINS))
WORD = r"[^\x20\x09-\x0D]+"
MOST_BUCKETS = 16_384
#: An id with more rows than this, and than one in ``MOST_HOT`` of all, is divided.
HOT_ROWS = 50_000
MOST_HOT = 1_000


def _bound(value: Column, use) -> Column:
    """Give a column a name inside an expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _probes() -> tuple[list[int], list[int]]:
    """Start and step of each bin's probe sequence; an odd step visits all bins."""
    mixed = [(j * 0x9E3779B1 ^ j * j * 0x85EBCA6B) >> 3 for j in range(1, BINS + 1)]
    return [m % BINS for m in mixed], [(m // BINS % (BINS // 2)) * 2 + 1 for m in mixed]


def packed_codes(text: Column) -> Column:
    """The fingerprint of a text as an array of longs; zeros if it has no words.

    A text of fewer words than a shingle is one shingle.
    """

    def shingles(words: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS),
            lambda i: F.xxhash64(*(words[i + k] for k in range(SHINGLE_WORDS))))
        return F.when(F.size(words) >= SHINGLE_WORDS, several).otherwise(F.array(F.xxhash64(words)))

    def smallest(hashes: Column) -> Column:
        """The smallest hash of each bin that has one, in the order of bins."""
        return F.filter(hashes, lambda h, i: (i == 0) | (
            F.shiftright(h, _BIN_SHIFT) != F.shiftright(hashes[F.greatest(i - 1, F.lit(0))], _BIN_SHIFT)))

    def by_bin(least: Column) -> Column:
        found = F.map_from_arrays(F.transform(least, lambda h: F.shiftright(h, _BIN_SHIFT).cast("int")), least)
        return _bound(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.try_element_at(m, j)))

    starts, steps = (F.array(*map(F.lit, p)) for p in _probes())

    def filled(bins: Column) -> Column:
        def borrow(value: Column, j: Column) -> Column:
            probes = [bins[(starts[j] + steps[j] * t).bitwiseAND(F.lit(BINS - 1))] for t in range(BINS)]
            return F.coalesce(value, *probes)

        return F.transform(bins, borrow)

    def pack(values: Column) -> Column:
        mask = F.lit((1 << BITS) - 1)
        return F.array(*(
            F.aggregate(F.slice(values, k * _PACKED + 1, _PACKED), F.lit(0).cast("long"),
                        lambda held, v: F.shiftleft(held, BITS).bitwiseOR(v.bitwiseAND(mask)))
            for k in range(_LONGS)))

    words = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    none = F.array(*[F.lit(0).cast("long")] * _LONGS)

    def codes(given: Column) -> Column:
        hashes = _bound(F.transform(given, lambda w: F.xxhash64(w)), shingles)
        ordered = F.sort_array(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1)))
        full = _bound(_bound(_bound(ordered, smallest), by_bin), filled)
        return F.when(F.size(given) == 0, none).otherwise(_bound(full, pack))

    return _bound(words, codes)


def code_hex(codes: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(codes[k])), 16, "0") for k in range(_LONGS)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two texts from their packed codes, 0 to 1.

    Bins agree by chance once in ``2 ** BITS``, which is taken off.  A text without words is
    like another one without words, and like nothing else.
    """
    ones = int("1".rjust(BITS, "0") * _PACKED, 2)
    differ = F.lit(0)
    for k in range(_LONGS):
        x = a[k].bitwiseXOR(b[k])
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1 / 2**BITS
    share = (1 - differ / float(BINS) - chance) / (1 - chance)
    empty = F.array(*[F.lit(0).cast("long")] * _LONGS)
    return F.when(a == b, 1.0).when((a == empty) | (b == empty), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hexadecimal) of every row, without any shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), code_hex(packed_codes(F.col(text))).alias("fingerprint"))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are above ``value``: those of a coarse list first, then of one of the fine lists."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    fine = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    coarse = F.array(*(F.lit(part[-1]).cast("long") for part in fine))  # bounds descend
    lists = F.array(*(F.array(*(F.lit(b).cast("long") for b in part)) for part in fine))
    whole = F.size(F.filter(coarse, lambda b: b > value))
    inner = F.size(F.filter(F.get(lists, whole), lambda b: b > value))
    return whole * width + F.when(whole < len(fine), inner).otherwise(0)


def with_next(docs: DataFrame, columns: dict[str, Column], doc_id: str = "doc_id", text: str = "text",
              bucket_rows: int = 2_000) -> DataFrame:
    """``doc_id``, ``text`` (null as empty), ``columns``, and ``next_`` of these: of the row that
    follows in descending ``doc_id`` order, nulls last; the first one follows the last.

    Ids are whole numbers; other types raise ``TypeError``.  Rows of one id are ordered by a
    hash of their text, and equal rows follow each other.  Ids are cut into buckets of about
    equal numbers of rows, so the texts are shuffled once; the first row of each bucket, the
    only one that another bucket asks for, is read again.  An id (or null) with very many rows
    has buckets of its own, by ranges of the hash, and very many equal rows go as one.
    """
    rows = docs.select(whole_ids(docs, doc_id).alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = rows.agg(F.count("doc_id")).first()[0]
    buckets = min(MOST_BUCKETS, n // bucket_rows)
    bounds: list[int] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0]
        bounds = sorted(set(found), reverse=True)
    last = len(bounds) + 1
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), last).otherwise(_bucket(F.col("doc_id"), bounds)))
    rows = rows.withColumn("content", F.xxhash64("text"))
    rows, copies = _divide_hot_ids(rows)
    names = ["doc_id", "text", *columns]

    # first row of each bucket, and which bucket comes before it
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "content")).alias("head"))
    ring = Window.orderBy("bucket")  # a row per bucket
    earlier = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("head.*", earlier.alias("before")).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "before")
    first = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["_id"]) & (
        rows["content"] == heads["_content"])).dropDuplicates(["before"])
    first = first.withColumns(columns)
    first = first.select(F.col("before").alias("bucket"), *(F.col(c).alias(f"_first_{c}") for c in names))

    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("content").desc())
    led = rows.withColumns(columns).withColumns(
        {f"_next_{c}": F.lead(c).over(order) for c in names} | {"_inside": F.lead(F.lit(True)).over(order)})
    joined = led.join(first, "bucket")
    inside = F.col("_inside")
    if copies:  # all but the last of equal rows are followed by their like
        joined = joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        last_one = F.col("_nth") == F.col("copies")
    else:
        last_one = F.lit(True)
    return joined.select(*names, *(
        F.when(~last_one, F.col(c)).when(inside, F.col(f"_next_{c}")).otherwise(F.col(f"_first_{c}")).alias(f"next_{c}")
        for c in names))


def _divide_hot_ids(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with finer buckets where an id has very many rows; and whether equal rows were put
    into one with ``copies``.

    What comes to the driver are at most ``MOST_HOT`` ids and as many texts' hashes.
    """
    least = max(HOT_ROWS, rows.count() // MOST_HOT)
    found = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    if not found:
        return rows, False
    found.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    hot = [r.doc_id for r in found]
    known = [h for h in hot if h is not None]
    parts = [-(-r.n // least) for r in found]
    wide = max(parts) + 1
    own = F.col("doc_id").isin(known) if known else F.lit(False)
    if None in hot:
        own = own | F.col("doc_id").isNull()
    own = F.coalesce(own, F.lit(False))
    listed = F.array(*[F.lit(h).cast("long") for h in known]).cast("array<bigint>")
    before = F.when(F.col("doc_id").isNull(), len(known)).otherwise(
        F.size(F.filter(listed, lambda h: h > F.col("doc_id"))))
    share = F.least(F.greatest(F.lit(0.5) - F.col("content") / F.lit(2.0**64), F.lit(0.0)), F.lit(1.0))
    mine = F.get(F.array(*map(F.lit, parts)), before)
    part = F.least(F.floor(share * mine), mine - 1)
    fine = before * wide + F.when(own, part + 1).otherwise(0)
    rows = rows.withColumn("bucket", F.col("bucket").cast("long") * ((len(hot) + 1) * wide) + fine)

    twins = rows.where(own).groupBy("doc_id", "content").agg(F.count("*").alias("n")).where(F.col("n") > least)
    twins = [(r.doc_id, r.content, r.n) for r in twins.collect()]
    if not twins:
        return rows, False
    table = rows.sparkSession.createDataFrame(twins, "_id long, _content long, copies int")
    marked = rows.join(F.broadcast(table), rows["doc_id"].eqNullSafe(table["_id"]) & (
        rows["content"] == table["_content"]), "left").drop("_id", "_content")
    one = marked.where("copies is not null").dropDuplicates(["doc_id", "content"])
    return marked.where("copies is null").withColumn("copies", F.lit(1)).unionByName(one), True


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of the text whose second half is replaced by the beginning
    of the next document, and how alike they are.

    Null texts count as empty.  Repeated rows each have their row.  A table of one row has
    itself as next document.
    """
    rows = with_next(docs, {"codes": packed_codes(F.col("text"))}, doc_id, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_codes", packed_codes(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        code_hex(F.col("codes")).alias("fingerprint"), code_hex(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
