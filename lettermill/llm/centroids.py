"""Lloyd's clustering over shards of columns, in exact whole numbers.

Vectors are cut into chunks of rows and blocks of columns; a shard is one chunk of one block.
A round has two parts.  Tasks over shards work out, for each vector, the exact partial squared
distance to the slice of every centroid that belongs to their block; the partial distances of
a chunk are added over its blocks, and the nearest centroid is taken.  Then each block sums
its columns over the vectors of each cluster, and from these sums the block's slice of the
centroids is replaced.  No task ever holds a whole centroid or a whole vector.

A round shuffles the partial distances (chunk by chunk, in the narrowest whole numbers that
hold them), the clusters, and at most once the shards; sums are added in each task first.
Every step is written to the shared folder, so a lost executor costs a part of one step.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import attach, materialise, ship_package

CHUNK_ROWS = 8_192
BLOCK_COLUMNS = 32
#: Squares of differences of such numbers, added over 512 columns, fit in 64 bits.
_PLAIN = 1 << 26
_LONG = (1 << 63) - 1


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) exactly; Python numbers where 64 bits might not hold later sums."""
    if not values.size or np.abs(values).max() * scale < _PLAIN:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, object)
    for at, value in np.ndenumerate(values):
        top, bottom = float(value).as_integer_ratio()
        out[at] = scale * top // bottom
    return out


def pack(numbers: np.ndarray) -> bytes:
    """A table of whole numbers, in the narrowest form that holds all of them."""
    if numbers.dtype == object:
        return b"j" + json.dumps(numbers.tolist()).encode()
    most = int(np.abs(numbers).max()) if numbers.size else 0
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return b"%d" % width + numbers.astype(f"<i{width}").tobytes()


def unpack(packed: bytes, columns: int) -> np.ndarray:
    if packed[:1] == b"j":
        rows = json.loads(packed[1:])
        out = np.empty((len(rows), columns), object)
        for k, row in enumerate(rows):
            out[k] = row
        return out
    return np.frombuffer(packed, f"<i{int(packed[:1])}", offset=1).astype(np.int64).reshape(-1, columns)


def _numbers(texts: list[list[str]]) -> np.ndarray:
    """Centroid slices, given as decimal texts."""
    exact = [[int(x) for x in row] for row in texts]
    if all(abs(x) < _PLAIN for row in exact for x in row):
        return np.array(exact, np.int64)
    out = np.empty((len(exact), len(exact[0])), object)
    for k, row in enumerate(exact):
        out[k] = row
    return out


def partial_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over the columns given: one row per vector, one column per centroid."""
    if rows.dtype == object or centroids.dtype == object:
        rows, centroids = rows.astype(object), centroids.astype(object)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def kept(vectors: DataFrame, dim: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (doubles) of vectors with exactly ``dim`` components, none null or not finite."""
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return given.where(F.coalesce((F.size("x") == dim) & ~bad, F.lit(False)))


def hashed_start(seed: int) -> Column:
    """Lower-case hex SHA-256 of ``<seed>:<vec_id>``; null for a null id, which is never a start."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def _cut(rows: DataFrame, dim: int, scale: int, chunk_rows: int, block_columns: int) -> DataFrame:
    """Shards (``chunk``, ``block``, ``n``, ``numbers``); those of block 0 also hold the ids."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                ids = part.column("vec_id")
                for block, at in enumerate(range(0, dim, block_columns)):
                    numbers = whole(values[:, at : at + block_columns], scale)
                    held = pa.ListArray.from_arrays([0, len(ids)], ids) if block == 0 else pa.nulls(1, pa.list_(ids.type))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([block], pa.int32()), pa.array([part.num_rows], pa.int32()),
                         pa.array([pack(numbers)], pa.binary()), held], ["chunk", "block", "n", "numbers", "ids"])
                chunk += 1

    return rows.mapInArrow(run, f"chunk long, block int, n int, numbers binary, ids array<{kind}>")


def _starts(rows: DataFrame, order: Column, clusters: int, dim: int, scale: int, block_columns: int) -> DataFrame:
    """``block``, ``cluster``, ``slice`` (decimal texts) of the first ``clusters`` rows in ``order``."""
    first = rows.withColumn("_key", order).where("_key is not null").orderBy("_key", "vec_id", "x").limit(clusters)
    first = first.select("x", (F.row_number().over(Window.orderBy("_key", "vec_id", "x")) - 1).alias("cluster"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cluster, x in zip(batch["cluster"], batch["x"]):
                numbers = [str(int(v)) for v in whole(np.array(x, np.float64), scale)]
                yield pd.DataFrame([(b, cluster, numbers[at : at + block_columns])
                                    for b, at in enumerate(range(0, dim, block_columns))],
                                   columns=["block", "cluster", "slice"])

    return first.mapInPandas(run, "block int, cluster int, slice array<string>")


def _assign(shards: DataFrame, centroids: DataFrame, dim: int, block_columns: int) -> DataFrame:
    """``chunk``, ``clusters`` (packed) and ``distances`` (null where 64 bits do not hold one)."""
    by_block = centroids.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("cluster", "slice")))["slice"].alias("slices"))

    def distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, numbers, slices in zip(*(batch.column(c) for c in ("chunk", "block", "numbers", "slices"))):
                against = _numbers(slices.as_py())
                found = partial_distances(unpack(numbers.as_py(), against.shape[1]), against)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()]), pa.array([len(against)], pa.int32()), pa.array([pack(found)], pa.binary())],
                    ["chunk", "k", "partial"])

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        total = sum(unpack(p, k).astype(object) if p[:1] == b"j" else unpack(p, k) for p in group["partial"])
        best = total.argmin(axis=1).astype(np.int64)  # the first of equal ones
        near = total[np.arange(len(total)), best]
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "clusters": [pack(best.reshape(-1, 1))],
                             "distances": [[int(d) if d <= _LONG else None for d in near.tolist()]]})

    partial = attach(shards.select("chunk", "block", "numbers"), by_block, ["block"], "inner", "chunk")
    partial = partial.mapInArrow(distances, "chunk long, k int, partial binary")
    return partial.groupBy("chunk").applyInPandas(nearest, "chunk long, clusters binary, distances array<long>")


def _add_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    def add(group: pd.DataFrame) -> pd.DataFrame:
        sums = [0] * len(group["sums"].iloc[0])
        for given in group["sums"]:
            sums = [a + int(b) for a, b in zip(sums, given)]
        head = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "n": [group["n"].sum()], "sums": [[str(s) for s in sums]]})

    kinds = {"block": "int", "cluster": "int", "part": "int"}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", "sums array<string>"])
    return rows.groupBy(*keys).applyInPandas(add, schema)


def _moved(shards: DataFrame, assigned: DataFrame, centroids: DataFrame, block_columns: int, dim: int) -> DataFrame:
    """Each block's slice of the centroids, from its own sums; a centroid without vectors stays."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, numbers, clusters in zip(*(batch.column(c).to_pylist() for c in ("block", "numbers", "clusters"))):
                rows = unpack(numbers, min(block_columns, dim - block * block_columns))
                of = unpack(clusters, 1)[:, 0]
                order = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
                counts = np.diff(np.r_[starts, len(of)])
                for cluster, n, total in zip(of[order][starts].tolist(), counts.tolist(),
                                             np.add.reduceat(rows[order], starts, axis=0).tolist()):
                    before = held.get((block, cluster))
                    held[block, cluster] = [n, total] if before is None else [
                        before[0] + n, [a + b for a, b in zip(before[1], total)]]
        if held:
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in held], pa.int32()), pa.array([c for _, c in held], pa.int32()),
                 pa.array([part] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([[str(x) for x in s] for _, s in held.values()], pa.list_(pa.string()))],
                ["block", "cluster", "part", "n", "sums"])

    both = shards.select("chunk", "block", "numbers").join(assigned.select("chunk", "clusters"), "chunk")
    found = both.drop("chunk").mapInArrow(sums, "block int, cluster int, part int, n long, sums array<string>")
    # in two steps, so that no group has more rows than a 64th of the tasks
    found = _add_sums(_add_sums(found, ["block", "cluster", "part"]).drop("part"), ["block", "cluster"])

    def mean(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["slice"] = [[str(int(s) // int(n)) for s in sums] for n, sums in zip(batch["n"], batch["sums"])]
            yield batch[["block", "cluster", "slice"]]

    new = found.mapInPandas(mean, "block int, cluster int, slice array<string>").withColumnRenamed("slice", "new")
    return centroids.join(new, ["block", "cluster"], "left").select(
        "block", "cluster", F.coalesce("new", "slice").alias("slice"))


def cluster(vectors: DataFrame, clusters: int, rounds: int, dim: int, scale: int, start: Column,
            vec_id: str = "vec_id", embedding: str = "embedding", chunk_rows: int = CHUNK_ROWS,
            block_columns: int = BLOCK_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Assignments (``vec_id``, ``cluster``, ``distance``) and centroids (``cluster``, ``centroid``).

    ``start`` orders the vectors, of which the first ``clusters`` are the first centroids (fewer
    vectors: fewer centroids); those for which it is null are none.  ``centroid`` is an array
    of decimal texts.  Components count as floor(``scale`` * x).

    Every kept row is a vector, also rows with a null or repeated id or with equal components;
    equally near centroids give the smaller number.  Vectors that :func:`kept` leaves out give
    no row.  Numbers of any size are exact; a squared distance over 2^63 - 1 is null.  Without
    a start no vector has a cluster, and there are no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = kept(vectors, dim, vec_id, embedding)
    shards = materialise(_cut(rows, dim, scale, chunk_rows, block_columns), "shards")
    centroids = materialise(_starts(rows, start, clusters, dim, scale, block_columns), "centroids")
    for _ in range(rounds):
        assigned = materialise(_assign(shards, centroids, dim, block_columns), "assigned")
        centroids = materialise(_moved(shards, assigned, centroids, block_columns, dim), "centroids")
    assigned = materialise(_assign(shards, centroids, dim, block_columns), "assigned")

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, packed in enumerate(batch.column("clusters").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(unpack(packed, 1)[:, 0], pa.int32()),
                     batch.column("distances")[k].values], ["vec_id", "cluster", "distance"])

    ids = shards.where("block = 0").select("chunk", "ids").join(assigned, "chunk")
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = ids.mapInArrow(opened, f"vec_id {kind}, cluster int, distance long")
    slices = F.array_sort(F.collect_list(F.struct("block", "slice")))["slice"]
    return found, centroids.groupBy("cluster").agg(F.flatten(slices).alias("centroid"))


def with_inertia(found: DataFrame, centroids: DataFrame) -> DataFrame:
    """Assignments with ``cluster_inertia`` and ``inertia`` (distance summed over the cluster and
    over all; null if it holds a null or is over 2^63 - 1) and the centroid's ``centroid_sha256``."""
    found = materialise(found, "clustered")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(total.alias("sum"), (F.count("distance") == F.count("*")).alias("known"))
    over = per.agg(F.sum("sum").alias("total"), F.min("known").alias("all_known"))
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    facts = (
        per.crossJoin(F.broadcast(over))  # one row
        .join(centroids.select("cluster", digest), "cluster")
        .select("cluster", F.when(F.col("known"), F.col("sum")).try_cast("long").alias("cluster_inertia"),
                F.when(F.col("all_known"), F.col("total")).try_cast("long").alias("inertia"), "centroid_sha256")
    )
    return attach(found, facts, ["cluster"], "inner", "vec_id").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
