"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistride.llm import minhash, packing, substrings, toxicity
from epistride.llm.common import Scratch, write_table

#: Documents from this toxicity score on go.
TOXIC = 0.3


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below TOXIC; the chain is fitted to the labels of the corpus.

    All columns of ``docs`` stay as they are, also those that bear the names of a model's results.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("score", "predicted", "spans", "scored")}
    scored = toxicity.score_documents(docs.withColumnsRenamed(own), labels, threshold=TOXIC)
    return scored.where("predicted = 0").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return minhash.one_of_each(docs, minhash.Near(words=5, percent=80))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words in passages of 20 words that occur earlier; those of which nothing is left go."""
    return substrings.without_repeats(docs, k=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash", remove_near_duplicates),
    ("substrings", remove_repeated_passages),
    ("best_two_fit", pack),
]

#: The first stage is a fitted model; tests hold every stage against a plain version on a small table instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as made:
        for _, stage in STAGES[:-1]:
            docs = made.write(stage(spark, docs, sf_dir), "docs")
        return write_table(STAGES[-1][1](spark, docs, sf_dir), "packed")
