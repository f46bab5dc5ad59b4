"""A training-corpus pipeline over documents: STAGES in order, and run() that chains them through Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisa.llm import decontaminate, mixing, quality, repair
from decisa.llm.jaccard_join import first_of_components
from decisa.llm.queries import tokenizer_path
from decisa.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; learnt from the labels of these documents."""
    labels = quality.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.fit(docs.select(F.col("doc_id").alias("key"), "text"), labels)
    return quality.accepted(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that n-gram Jaccard links connect."""
    return first_of_components(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or repeated."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as Re-Pair shards; a row for each document as read back."""
    return repair.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_distinct),
    ("decontamination", keep_clean),
    ("mixing", mix),
    ("token_output", tokenize),
]

#: A trained model and near-duplicate links are beyond plain SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written to the shared folder and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
