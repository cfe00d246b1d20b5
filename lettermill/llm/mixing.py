"""Mixing sources to target weights by weighted sampling without replacement.

Every source has a target in words.  A source is first taken whole as often as it fits into
its target; the rest of the target is filled with single documents in the order of
exponential keys ``-ln(u) / weight``, where ``u`` is a fixed random number of the document
and ``weight`` its quality weight (Efraimidis and Spirakis).

One source may own most rows.  Keys are therefore cut into 65,536 ranges; words are summed
per source and range, and only the one range of each source in which its target is reached
is ordered row by row.  Weights only count against each other, so they are scaled to one at
least; then no range holds more than (largest / smallest weight) / 65,536 of a source's rows
by expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.ordering import number_in_order
from lettermill.llm.textmap import fresh
from lettermill.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 65_536


def words(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source.

    ``sizes`` has ``source`` (distinct, nulls allowed) and ``source_size``.  Sources in the
    order of their names, null last, get ``weights`` in turn.  Together they get ``share``
    of all words; none gets more than ``most`` times its size, and what is over goes to the
    others by weight.  Each round of sharing is one sum over the sources.
    """
    ordered = number_in_order(sizes, [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ordered = materialise(
        ordered.select("source", "source_size", turn.cast("double").alias("weight"),
                       (F.col("source_size") * float(most)).alias("cap")), "sources")
    total = float(ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    full, settled = F.lit(False), -1
    while True:
        row = ordered.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row.n == settled or row.weight == 0:
            break
        settled = row.n
        part = F.lit(total - row.held) * F.col("weight") / F.lit(row.weight)
        full = full | (part > F.col("cap"))
    target = F.col("cap") if row.weight == 0 else F.when(full, F.col("cap")).otherwise(part)
    return ordered.select("source", "source_size", target.alias("target"))


def take(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``copies`` of each document.

    ``rows`` has ``doc_id``, ``source``, ``size``, ``weight``, ``u`` and ``content``.  The
    last document taken in part of an epoch is the one that brings the sum nearest to the
    target.  Equal keys are ordered by id, then size, then content; a weight that is null,
    not finite or not above zero counts as one.
    """
    good = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    rows = rows.withColumn("weight", F.when(good, F.col("weight")).otherwise(1.0))
    least = rows.agg(F.min("weight")).first()[0] or 1.0
    key = -F.log("u") / (F.col("weight") / least)
    part = F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")
    keyed = rows.withColumn("key", key).withColumn("part", part)

    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (
        parts.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(targets, parts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("state", F.when(F.col("rest") <= 0, 0)  # whole epochs only, empty documents too
                    .when(F.col("before") + F.col("words") <= F.col("rest"), 1)
                    .when(F.col("before") > F.col("rest"), 0))  # null: the target is reached inside
    )
    known = _with_state(keyed, state)
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "content").rowsBetween(
        Window.unboundedPreceding, -1)
    edge = known.where(F.col("state").isNull())
    edge = edge.withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn(
        "state", (F.col("sum") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("sum")
    return known.where(F.col("state").isNotNull()).unionByName(edge).withColumn(
        "copies", F.col("epochs") + F.col("state")).drop("key", "part", "epochs", "rest", "state", "before", "words")


def _with_state(keyed: DataFrame, state: DataFrame) -> DataFrame:
    state = state.withColumnRenamed("source", "_source").withColumnRenamed("part", "_part")
    same = keyed["source"].eqNullSafe(state["_source"]) & (keyed["part"] == state["_part"])
    return keyed.join(state, same).drop("_source", "_part")


def mix(docs: DataFrame, weight: DataFrame | None = None, source_weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text), ``source``, ``size``, ``source_size``,
    ``target`` and ``copies`` of every row.

    ``weight`` has ``doc_id`` and ``weight``, one row per id at most; without it all weigh
    the same.  Null sources are one source.  Null and empty texts have size 0.  Only ids,
    sizes and hashes are shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       words(text).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("content"))
    if weight is not None:
        rows = rows.join(weight.select("doc_id", F.col("weight").cast("double")), "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = materialise(rows.withColumn("u", draw("doc_id", seed)), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, source_weights, share, most), "mix-targets")
    return take(rows, targets)


def mixed_rows(docs: DataFrame, picks: DataFrame, doc_id: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    Rows that share id, text and source are told apart by their number only, since the mix may
    take one of them once more than another.
    """
    mine, of, body, origin, each, more, nth, copy = fresh(
        docs.columns, "mine", "of_id", "of_content", "of_source", "each", "more", "nth", "copy")
    taken = picks.groupBy("doc_id", "content", "source").agg(
        F.min("copies").alias(each), (F.sum("copies") - F.min("copies") * F.count("*")).alias(more)
    ).withColumnsRenamed({"doc_id": of, "content": body, "source": origin}).where((F.col(each) > 0) | (F.col(more) > 0))
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text).cast("string")))
    same = keyed[doc_id].eqNullSafe(taken[of]) & (keyed[mine] == taken[body])
    same = same & keyed[source].cast("string").eqNullSafe(taken[origin])
    number = F.row_number().over(Window.partitionBy(doc_id, mine, origin).orderBy(doc_id))
    times = (F.col(each) + (F.col(nth) <= F.col(more)).cast("long")).cast("int")
    return (
        keyed.join(taken, same).withColumn(nth, number)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
        .select(*docs.columns)
    )
