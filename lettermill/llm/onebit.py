"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is scaled to length one and turned by a fixed random rotation; of each component
only the sign is kept, packed to bits, together with the vector's length and with how well
the signs stand for the turned vector.  From these the inner product with any query can be
estimated without bias, with an error bound that holds with high probability.  A vector is
looked at exactly only if its upper bound reaches the k-th best lower bound.

Queries and vectors are compared in blocks of bounded size.  Equal vectors are one entry of
the index with their smallest ids, of which no more can be among the k nearest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import materialise, ship_package

NEAREST = 20
QUERY_BLOCK = 1_024
VECTOR_BLOCK = 16_384
#: How many standard errors the bounds are wide.
WIDTH = 3.0


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and the inner product of each turned unit vector with its signs."""
    dim = vectors.shape[1]
    lengths = np.sqrt((vectors**2).sum(axis=1))
    turned = (vectors / lengths[:, None]) @ rotation(dim, seed)
    return np.packbits(turned > 0, axis=1), lengths, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimate(codes: np.ndarray, lengths: np.ndarray, fit: np.ndarray, queries: np.ndarray, width: float = WIDTH,
             seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and their error bounds."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim, seed)).astype(np.float32)
    scale = lengths / fit / np.sqrt(dim)
    error = lengths * np.sqrt(np.maximum(0, 1 - fit**2)) / fit * width / np.sqrt(max(1, dim - 1))
    size = np.sqrt((queries**2).sum(axis=1))
    return (turned @ signs.T) * scale.astype(np.float32), size[:, None].astype(np.float32) * error.astype(np.float32)


def search_block(queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, lengths: np.ndarray, fit: np.ndarray,
                 ids: np.ndarray, nearest: int, width: float = WIDTH):
    """For each query: places and exact products of its best vectors, ties to smaller ids.  Also
    yields how many vectors were looked at exactly."""
    for start in range(0, len(queries), 128):
        part = queries[start : start + 128]
        guess, error = estimate(codes, lengths, fit, part, width)
        if len(vectors) > nearest:
            least = np.partition(guess - error, len(vectors) - nearest, axis=1)[:, len(vectors) - nearest, None]
            wanted = guess + error >= least
        else:
            wanted = np.ones(guess.shape, bool)
        for row in range(len(part)):
            at = np.flatnonzero(wanted[row])
            products = vectors[at] @ part[row]
            best = np.lexsort((ids[at], -products))[:nearest]
            yield start + row, at[best], products[best], len(at)


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of rows that take part."""
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                        F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return given.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)


def build_index(rows: DataFrame, nearest: int = NEAREST, vec_id: str = "vec_id",
                embedding: str = "embedding") -> DataFrame:
    """One row for each distinct vector: ``class_id`` (smallest id), ``members`` (the
    ``nearest`` + 1 smallest ids), ``embedding``, ``dim``, packed ``code``, ``length``, ``fit``.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part.
    """
    ship_package(rows.sparkSession)
    nth = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = usable(rows, vec_id, embedding).withColumn("nth", nth).where(F.col("nth") <= nearest + 1)
    classes = few.groupBy("embedding").agg(
        F.min("vec_id").alias("class_id"), F.array_sort(F.collect_set("vec_id")).alias("members"))
    classes = classes.withColumn("dim", F.size("embedding"))
    schema = "class_id long, members array<long>, embedding array<double>, dim int, code binary, length double, fit double"

    def code(batches):
        for batch in batches:
            batch["code"], batch["length"], batch["fit"] = None, 0.0, 0.0
            for dim, part in batch.groupby("dim"):
                bits, lengths, fit = encode(np.stack(part["embedding"].to_numpy()))
                batch.loc[part.index, "code"] = pd.Series([b.tobytes() for b in bits], part.index)
                batch.loc[part.index, "length"], batch.loc[part.index, "fit"] = lengths, fit
            yield batch[["class_id", "members", "embedding", "dim", "code", "length", "fit"]]

    return materialise(classes.mapInPandas(code, schema), "vector-index")


def search(index: DataFrame, queries: DataFrame, nearest: int = NEAREST, query_block: int = QUERY_BLOCK,
           vector_block: int = VECTOR_BLOCK, width: float = WIDTH) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest vectors of each query.

    ``queries`` has ``vec_id`` and ``embedding``; repeated rows count once.  A vector of the
    query's own id is not one of its neighbours, nor is one of another length.
    """
    asked = queries.distinct().join(index.select("embedding", "class_id"), "embedding")
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")), "asked")
    shapes = index.select("class_id", "dim", "embedding").join(
        asked.select(F.col("query_class").alias("class_id")).distinct(), "class_id")
    query_blocks = max(1, -(-shapes.count() // query_block))
    vector_blocks = max(1, -(-index.count() // vector_block))

    def block(n: int):
        return F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = shapes.withColumn("qb", block(query_blocks)).withColumn("vb", every(vector_blocks))
    left = left.select(*(F.col(c).alias(c) for c in left.columns))  # both sides come from the index
    right = index.select("class_id", "dim", "embedding", "code", "length", "fit").withColumn(
        "vb", block(vector_blocks)).withColumn("qb", every(query_blocks))
    keys = ["dim", "qb", "vb"]

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_class": [], "class_id": [], "score": []})
        codes = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
        ids, q_ids = v["class_id"].to_numpy(), q["class_id"].to_numpy()
        found = search_block(np.stack(q["embedding"].to_numpy()), np.stack(v["embedding"].to_numpy()), codes,
                             v["length"].to_numpy(), v["fit"].to_numpy(), ids, nearest + 1, width)
        rows = [(np.full(len(at), q_ids[k]), ids[at], products) for k, at, products, _ in found]
        return pd.DataFrame(dict(zip(("query_class", "class_id", "score"), map(np.concatenate, zip(*rows)))))

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compare, "query_class long, class_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id"))
    best = pairs.withColumn("nth", nth).where(F.col("nth") <= nearest + 1)
    rows = best.join(index.select("class_id", "members"), "class_id").select(
        "query_class", "score", F.explode("members").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= nearest + 1).drop("nth")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        rows.join(asked, "query_class").where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
    )
