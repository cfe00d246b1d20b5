"""From raw documents to token ids: toxicity, language, near copies, source mix, encoding.

Every stage but the last takes and returns the columns of ``documents``; its decision is
which rows go on, and how often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import bpe, langid, mixing, queries, simhash, toxicity
from lettermill.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a lexicon learned from labelled ones among them."""
    labels = queries.table(spark, sf_dir, "labels")
    return toxicity.clean_rows(docs, toxicity.learn(docs, labels, toxicity.fold_out()))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages whose profiles are learned from them."""
    return langid.known_rows(docs, langid.learn(docs.where(~langid.fold_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs, mixing.mix(docs, queries.quality_weights(spark, sf_dir)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document, repeated ones too: its ids, and digests of them and of the text
    that decoding them gives."""
    return bpe.encode_columns(docs, queries.word_tokenizer(), ["ids", "ids_sha256", "decoded_sha256"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe_encode", encode),
]

#: SimHash, learned models and BPE have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each one's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
