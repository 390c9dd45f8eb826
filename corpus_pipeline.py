"""The corpus pipeline: five stages from ``documents`` to token files.

Each stage works on all that the one before kept, is written as Parquet to
the session's shared folder and read again; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlens.llm import decontaminate, jaccard_join, mixing, token_files, weak_quality
from pairlens.session import materialize, new_shared_subdir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return weak_quality.keep_good(docs, weak_quality.fit_quality(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with 5-word shingle Jaccard of 0.8 or more, the one of the smallest id stays."""
    return jaccard_join.one_per_class(docs, k=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")
                                           .select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, at least once."""
    return mixing.mix_sources(docs, repeat_limit=2.0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and their digest read back."""
    path = new_shared_subdir(spark, "token-files")
    token_files.write_token_files(docs, path)
    return token_files.read_token_files(spark, path)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mix),
          ("token-ID / binary output", tokens)]

#: The classifier, the mixture and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
