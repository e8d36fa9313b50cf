"""The corpus pipeline: each stage's rows are written as Parquet and read again
as the next stage's documents.  Every stage decides on all that its predecessor
kept, and all but the last return the columns of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tankcast.llm import decontaminate, line_dedup, minhash, pieces, toxicity
from tankcast.llm.common import table
from tankcast.session import checkpoint_dir


SHORTEST = 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; every document stays.  ``n_chars``
    is left as the source gave it."""
    return line_dedup.drop_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate class stays."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding ten words in a row of a benchmark item, or a whole item
    of ``SHORTEST`` to nine words, go.  Shorter items are common phrases, found in
    clean documents; ``op2`` counts them."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_words=SHORTEST)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and what they decode to."""
    return pieces.encode_and_check(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", as_pieces),
]

# A trained model, signatures and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
