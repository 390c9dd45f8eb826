"""Evaluation inputs derived from the driver's tables.

The reference reads sentence-pair files; the test tables hold documents and
labels. These plans derive the reference's input shapes from them with
Spark so every query's work grows with the tables (see FIXTURES.md). Every
text is used whole: pairs come from *all* neighbouring sentences of a
document, not from a prefix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENTAILMENT, NOT_ENTAILMENT, EvalConfig, default_config
from ..functions.text import adjacent_pairs, adjacent_triples, sentences

# The stand-in generator's answers, chosen by prompt length
# modulo 8. They mix hits, misses and unparsable text for the label parser.
STUB_ANSWERS = ["Yes.", "no", "I think no, yes", "yes!", "", "Sure. Yes,", "other", "..NO.,"]
STUB_MODEL = "stub"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_config() -> EvalConfig:
    cfg = default_config()
    cfg.models[STUB_MODEL] = STUB_MODEL
    return cfg


def stub_factory(model):
    """Deterministic stand-in for a text generator: answer by prompt length."""
    answers = STUB_ANSWERS

    def fn(prompts: pd.Series):
        return [answers[len(p) % len(answers)] if p is not None else None for p in prompts]
    return fn


def labelled_documents(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """documents JOIN labels on doc_id (``how="left"`` keeps documents without
    a label). Spark picks the join strategy from the scan statistics
    (broadcast only under the size threshold)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", how)


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def gold_from_quality(q="quality"):
    """Gold label; an unlabelled document's pairs have none."""
    return F.when(F.col(q) == 1, F.lit(ENTAILMENT)).when(F.col(q).isNotNull(), F.lit(NOT_ENTAILMENT))


def pairs(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """dataset, pair_id, pair_no, language, premise, hypothesis, gold_label
    (+ quality, toxic) for every pair of neighbouring sentences. Queries that
    need no gold label take every document (``labelled=False``)."""
    # the sentence array is its own column: the pair expressions refer to it
    # several times and must not re-split the text for each reference; a
    # missing text counts as empty, so every labelled document yields a pair
    j = labelled_documents(spark, sf_dir, "inner" if labelled else "left").select(
        "doc_id", "source", "lang", "quality", "toxic", sentences(_text()).alias("s"))
    exploded = j.select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("pair_id"),
        F.col("lang").alias("language"), "quality", "toxic",
        F.posexplode(adjacent_pairs("s")).alias("pair_no", "p"))
    return exploded.select(
        "dataset", "pair_id", F.col("pair_no").cast("bigint").alias("pair_no"), "language",
        F.col("p.premise").alias("premise"), F.col("p.hypothesis").alias("hypothesis"),
        gold_from_quality().alias("gold_label"), "quality", "toxic")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of every document without what labels say of them: dataset,
    pair_id, pair_no, language, premise, hypothesis. (A document with several
    labels has its pairs once for each of them: :func:`per_label`.)"""
    docs = table(spark, sf_dir, "documents")
    exploded = docs.select("doc_id", "source", "lang", sentences(_text()).alias("s")).select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("pair_id"), F.col("lang").alias("language"),
        F.posexplode(adjacent_pairs("s")).alias("pair_no", "p"))
    return exploded.select("dataset", "pair_id", F.col("pair_no").cast("bigint").alias("pair_no"), "language",
                           F.col("p.premise").alias("premise"), F.col("p.hypothesis").alias("hypothesis"))


def per_label(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents (pair_id) as often as :func:`pairs` has them with
    ``labelled=False``: once for each label, or once without one."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id"))
    return rows.join(labels, "pair_id", "left")


def choice_rows(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """two-choice rows (rid, win_no, startphrase, ending1, ending2, labels)
    from every window of three neighbouring sentences; with ``labelled=False``
    of every document, labels missing where it has none."""
    j = labelled_documents(spark, sf_dir, "inner" if labelled else "left").select("doc_id", "quality", sentences(_text()).alias("s"))
    ex = j.select(F.col("doc_id").alias("rid"), "quality",
                  F.posexplode(adjacent_triples("s")).alias("win_no", "w"))
    return ex.select("rid", F.col("win_no").cast("bigint").alias("win_no"),
                     F.col("w.first").alias("startphrase"), F.col("w.second").alias("ending1"),
                     F.col("w.third").alias("ending2"), F.col("quality").alias("labels"))


# A word -> label mapping for parsing whole documents as
# answers (frequent words of the four languages plus yes/no), so the parser
# sees hits early, late and never within long texts.
WORD_MAPPING = {"yes": "entailment", "no": "not_entailment", "the": "entailment",
                "and": "not_entailment", "la": "entailment", "der": "not_entailment"}

PARAPHRASE_MARK = " Original sentence: "
PARAPHRASE_END = " Paraphrase: "


def stub_paraphraser(model):
    """Deterministic stand-in for a paraphrasing model: a numbered, lower-cased
    copy of the sentence plus a second line, the shape real answers have."""
    def fn(prompts: pd.Series):
        out = []
        for p in prompts:
            if p is None:
                out.append(None)
                continue
            s = p[p.index(PARAPHRASE_MARK) + len(PARAPHRASE_MARK): len(p) - len(PARAPHRASE_END)]
            out.append(f"{len(s) % 10}. {s.lower()}\nNote: literal.")
        return out
    return fn


def side_of(pair_id: str = "pair_id"):
    """Which sentence is paraphrased: premise for even ids, hypothesis for odd."""
    return F.when(F.col(pair_id) % 2 == 0, F.lit("p")).otherwise(F.lit("h"))


def two_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with a two-class label in mixed case."""
    return pairs(spark, sf_dir).withColumn(
        "label", F.when(F.col("quality") == 1, F.lit("Entailment")).otherwise(F.lit("CONTRADICTION")))


def three_label():
    """The three-class gold label of a labelled pair."""
    return (F.when(F.col("quality") == 0, F.lit("contradiction"))
             .when(F.col("toxic") == 1, F.lit("neutral"))
             .otherwise(F.lit("entailment")))


def three_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with a three-class gold label and their language."""
    return pairs(spark, sf_dir).withColumn("gold_label", three_label())
