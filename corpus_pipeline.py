"""The corpus pipeline: quality filter, near-dedup, exact-substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: the packed
pieces).  Each works on all rows that the stage before kept, statistics included, and judges rows, not ids.

Defined results: null and empty texts are scored, are near copies of each other (one row of them stays), have nothing to cut and hold
no test item; of exact copies and near copies the row of the least doc_id stays (null ids last, then the least other
columns), so rows that repeat an id with another text are judged by their own text; a text of any length is read whole; columns
beyond those of documents stay as they are under any name; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import decontam, packing, quality, simhash, suffix
from tonewright.llm.common import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the rows at hand."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles one row stays, that of the least doc_id."""
    return simhash.distinct_documents(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur more than once are cut out of the texts; n_chars is that of what is left."""
    found = suffix.repeated_strings(docs.select("doc_id", "text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")), carry=("row",))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(new.get(c, F.col(f"carried.row.`{c}`")).alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a copy of a test item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path(packing.TOKENIZER), ranks=public_tokenizers.path(packing.RANKS))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't train a network; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what each returns is checkpointed before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
