"""Near copies by SimHash fingerprints.

Two fingerprints are linked if they differ in at most a few bits.  To find such pairs
without comparing all: cut a fingerprint into segments of two bits and count the ones in
each.  Fingerprints that differ in ``d`` bits have count vectors whose Manhattan distance
is at most ``d``.  The vector is seen in a few views, each with an equal share of the
segments; the views' distances add up, so in one view at least the distance is small (for
four bits: two at most in the first of two views, or one at most in the second).  Each view
is a grid whose cells are count vectors.  A fingerprint is put into its own cell and the
cells next to it, so that any two at distance two or less share a cell.  What shares a cell
is checked for the exact number of bits.

Equal fingerprints are one node, so copies make no pairs.  Inside a crowded cell the search
walks from a node to those not yet reached, so a cell gives fewer links than it has nodes;
a cell beyond a stated size is divided into pairs of blocks and checked by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.components import connected_components
from lettermill.llm.textmap import fresh, text_parts
from lettermill.session import materialise, ship_package

SHINGLE_WORDS = 4
MAX_BITS = 4
_SEED = 42
_TEXT_PART = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_SMALL_CELL = 6
CELL_LIMIT = 20_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text; very long ones are read in parts that overlap."""
    from xxhash import xxh64_intdigest as digest

    ones, n, carry = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text or b""):
        words = carry + words
        hashes = [digest(b" ".join(s), _SEED) for s in zip(*(words[k:] for k in range(shingle)))]
        if hashes:
            n += len(hashes)
            ones += _bit_sums(np.array(hashes, np.uint64))
        carry = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
    if n == 0:
        return digest(b" ".join(carry), _SEED) if carry else 0
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, in parts cut at white space."""
    at = 0
    while len(text) - at > _TEXT_PART:
        gap = _SPACE.search(text, at + _TEXT_PART)
        if gap is None:
            break
        yield text[at : gap.start()].lower().split()
        at = gap.end()
    yield text[at:].lower().split()


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, from the lowest on."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text) and ``fp`` (64 bits in a long) per row.

    Null and empty texts have fingerprint zero; other columns are not read.
    """
    ship_package(docs.sparkSession)
    body = F.col(text).cast("string")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("content"),
                        body.cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for _, texts in text_parts(batch.column("text")) for t in texts],
                             np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(found.view(np.int64))],
                ["doc_id", "content", "fp"])

    return given.mapInArrow(run, f"doc_id {kind}, content long, fp long")


def view_plan(max_bits: int) -> list[tuple[list[int], int]]:
    """Segments (of two bits) of each view, and the Manhattan distance it must find.

    If every view's distance were above its share, the sum would be above ``max_bits``.
    """
    views = max(1, -(-max_bits // 2))
    spare = max_bits - (views - 1)
    shares = [spare // views + (k < spare % views) for k in range(views)]
    return [(s.tolist(), r) for s, r in zip(np.array_split(np.arange(32), views), shares)]


def grid_cells(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays (cell, fingerprint): where each fingerprint is put in each view."""
    for view, (segments, radius) in enumerate(view_plan(max_bits)):
        counts = [(fps >> np.uint64(2 * s) & np.uint64(1)) + (fps >> np.uint64(2 * s + 1) & np.uint64(1))
                  for s in segments]
        own = np.full(len(fps), view << 40 if len(segments) < 32 else 0, np.uint64)
        for k, c in enumerate(counts):
            own |= c << np.uint64(2 * k)
        yield own, fps
        for k, c in enumerate(counts):
            step = np.uint64(1 << 2 * k)
            if radius >= 1:  # for distance one, it is enough that the lower one steps up
                yield own[c < 2] + step, fps[c < 2]
            if radius >= 2:
                yield own[c > 0] - step, fps[c > 0]


def _bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _walk(nodes: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what can be connected: breadth first, only to nodes not yet reached."""
    found, rest = [], nodes
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            for node in front.pop():
                near = _bits_between(rest, node) <= max_bits
                if near.any():
                    new = rest[near]
                    rest = rest[~near]
                    found.append((np.full(len(new), node, np.uint64), new))
                    front.append(new)
                    if not len(rest):
                        break
    return found


def _links_in_cells(max_bits: int, limit: int | None):
    """A task over rows ordered by cell: links, and the rows of cells above ``limit`` as they are."""

    def pairs(cells: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        sizes = np.diff(np.r_[starts, len(cells)])
        small = np.repeat(sizes <= _SMALL_CELL, sizes)
        for d in range(1, _SMALL_CELL):
            at = np.flatnonzero(small[d:] & (cells[d:] == cells[:-d]))
            at = at[_bits_between(fps[at], fps[at + d]) <= max_bits]
            if len(at):
                yield fps[at], fps[at + d]
        for k in np.flatnonzero(sizes > _SMALL_CELL):
            yield from _walk(fps[starts[k] : starts[k] + sizes[k]], max_bits)

    def out(a: np.ndarray, b: np.ndarray, cells: np.ndarray | None = None) -> pa.RecordBatch:
        held = pa.nulls(len(a), pa.int64()) if cells is None else pa.array(cells)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), held], ["a", "b", "crowded"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps, crowded = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            cells = np.r_[cells, batch.column("cell").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            if not len(cells):
                continue
            if crowded is not None:  # the rest of a cell that was found to be too large
                n = int(np.searchsorted(cells != crowded, True))
                if n:
                    yield out(fps[:n], fps[:n], cells[:n])
                cells, fps = cells[n:], fps[n:]
                if not len(cells):
                    continue
                crowded = None
            last = int(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])[-1])  # may go on in the next batch
            if last:
                for part in _found(pairs(cells[:last], fps[:last])):
                    yield out(*part)
                cells, fps = cells[last:], fps[last:]
            if limit is not None and len(cells) > limit:
                yield out(fps, fps, cells)
                crowded, cells, fps = cells[0], cells[:0], fps[:0]
        if len(cells):
            for part in _found(pairs(cells, fps)):
                yield out(*part)

    return run


def _found(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b, n = [], [], 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        n += len(x)
        if n > 100_000:
            yield np.concatenate(a), np.concatenate(b)
            a, b, n = [], [], 0
    if n:
        yield np.concatenate(a), np.concatenate(b)


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links ``a``, ``b`` among the distinct fingerprints of column ``fp``.

    Not all pairs: enough that everything linked by a chain of near pairs is connected.
    """

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, fps in grid_cells(batch.column("fp").to_numpy().view(np.uint64), max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.view(np.int64)), pa.array(fps.view(np.int64))], ["cell", "fp"])

    schema = "a long, b long, crowded long"
    placed = distinct.select("fp").mapInArrow(place, "cell long, fp long")
    ordered = placed.repartition("cell").sortWithinPartitions("cell", "fp")
    first = materialise(ordered.mapInArrow(_links_in_cells(max_bits, cell_limit), schema), "near-pairs")
    # crowded cells: every pair of blocks becomes a cell of its own
    crowded = first.where(F.col("crowded").isNotNull()).select(F.col("crowded").alias("cell"), F.col("a").alias("fp"))
    blocks = crowded.groupBy("cell").agg(F.ceil(2 * F.count("*") / F.lit(cell_limit)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = (
        crowded.join(blocks, "cell").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "fp")
    )
    second = split.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(
        _links_in_cells(max_bits, None), schema)
    return first.where(F.col("crowded").isNull()).select("a", "b").unionByName(second.select("a", "b"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, doc_id: str = "doc_id",
                text: str = "text", cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``doc_id``, ``content``, ``fp`` and ``component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that a chain of links reaches, and null only
    where no row of the component has an id.  Repeated rows stay, as members of one
    component; texts without words all have fingerprint zero and are linked like others.
    """
    known = materialise(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    nodes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(near_links(nodes, max_bits, cell_limit))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    placed = materialise(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id", "root")
    return known.join(named, "fp").select("doc_id", "content", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The row of the smallest ``doc_id`` of each component, whole; rows without an id come
    last, and of equal rows one stays.  All columns of ``docs`` are kept as they are."""
    found = near_copies(docs, shingle, max_bits, doc_id, text)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("best")
    mine, kept_id, kept_content = fresh(docs.columns, "content", "kept_id", "kept_content")
    kept = found.groupBy("root").agg(best).select(
        F.col("best.doc_id").alias(kept_id), F.col("best.content").alias(kept_content))
    keyed = docs.withColumn(mine, F.xxhash64(F.col(text).cast("string")))
    same = keyed[doc_id].eqNullSafe(kept[kept_id]) & (keyed[mine] == kept[kept_content])
    return keyed.join(kept, same).dropDuplicates([doc_id, mine]).select(*docs.columns)


def to_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
