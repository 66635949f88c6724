"""A corpus made ready for training: five stages over ``documents``.

Each stage gets the documents that the one before kept, and returns them in the
same columns; the last one returns tokens. ``run`` writes every stage as a table in
the cluster's shared folder and reads it again, so a lost executor costs part of
one stage at most.

Repeated rows are rows of their own to every stage but near dedup, which keeps one of
them. An empty table passes through all stages. Columns besides those of documents
stay as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbooks.llm import decontaminate, linededup, queries, simhash, toxicity
from fleetbooks.llm.common import small_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of those given.

    A null or empty text has the score of one without any learned word. Without usable
    labels every document stays.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; the documents stay, with ``n_chars`` as left.

    A null text stays null, and so does its ``n_chars``; a text may be left empty.
    """
    # Columns of the documents that are called like the operator's counts stay theirs.
    aside = {c: f"own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    found = linededup.without_repeats(docs.withColumnsRenamed(aside))
    found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, null first.

    Documents without a word, null texts among them, are copies of each other.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty or more stands in a benchmark phrase.

    A document without words stays, and all do where the benchmark is empty.
    """
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids and back; a null text is an empty one."""
    small_batches(spark)
    return queries.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]

# Classifiers and fingerprints are not SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
