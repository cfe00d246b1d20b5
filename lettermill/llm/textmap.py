"""Apply a function of texts to the rows of a table, batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lettermill.session import ship_package

_ROWS = 300
_BYTES = 2e6


def text_parts(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Where a run of texts starts, and the texts, of at most 300 texts and about 2 MB; a longer
    text is a run of its own.  Only one run at a time is held as Python objects."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, n in enumerate(lengths.tolist()):
        if at > start and (at - start >= _ROWS or held + n > _BYTES):
            yield start, column.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += n
    if start < len(column):
        yield start, column.slice(start).to_pylist()


def map_texts(docs: DataFrame, score: Callable[[list[bytes | None]], list], fields: str,
              keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` columns and the columns that ``score`` returns (in the order of ``fields``).

    Texts are given as UTF-8, null as None.
    """
    ship_package(docs.sparkSession)
    given = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).cast("string").cast("binary").alias("_text"))
    names = list(keep)
    made_fields = [f.split() for f in fields.split(",")]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text"]
    schema = ", ".join([*kept, *(f"_{k} {kind}" for k, (_, kind) in enumerate(made_fields))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_parts(batch.column("_text")):
                made = [pa.array(values) for values in score(texts)]
                held = [batch.column(n).slice(start, len(texts)) for n in names]
                yield pa.RecordBatch.from_arrays([*held, *made], [*names, *(f"_{k}" for k in range(len(made)))])

    made = given.mapInArrow(run, schema)
    return made.select(*keep, *(F.col(f"_{k}").alias(name) for k, (name, _) in enumerate(made_fields)))


def filter_texts(docs: DataFrame, wanted: Callable[[list[bytes | None]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``wanted`` says yes to."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [np.asarray(wanted(texts), bool) for _, texts in text_parts(batch.column(at).cast(pa.binary()))]
            yield batch.filter(pa.array(np.concatenate(yes) if yes else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def whole_ids(docs: DataFrame, doc_id: str) -> Column:
    """``doc_id`` as a long; only whole numbers have the order that is asked for."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} must be a whole number, not {kind.simpleString()}")
    return F.col(doc_id).cast("long")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like the given ones that are not yet taken, whatever their case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text falls into the given part; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, out: Column, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0 or 1) of at most ``rows`` labelled documents that are not held out.

    The sample follows a hash of the id, so it does not depend on the order of rows.  Rows
    of one id with different labels count as the larger one; of different texts of one id, the
    one with the smallest hash counts.  The ids are broadcast, and each task keeps one text of
    an id, so that next to no text is shuffled.
    """
    known = labels.where(~out & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = F.broadcast(known)  # ``rows`` ids at most
    found = texts.join(known, texts["doc_id"] == known["_id"])
    return found.groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
