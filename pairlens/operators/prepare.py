"""Dataset preparation: role columns, label folding, filters and the four
reshapes of the source datasets into one pair table with binary labels
(PRJ-1..4, FLT-1..3, PRE-1..4). All row-local except the union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTAILMENT, NOT_ENTAILMENT
from .checks import checked

BINARY = (ENTAILMENT, NOT_ENTAILMENT)
# Source label domains of the two- and three-label datasets.
TWO_LABELS = ("entailment", "contradiction")
THREE_LABELS = ("entailment", "contradiction", "neutral")


def role_columns(df: DataFrame, prem_col: str, hyp_col: str, label_col: str,
                 keep: list[str] | None = None) -> DataFrame:
    """PRJ-1: configured column names -> premise / hypothesis / label."""
    missing = [c for c in (prem_col, hyp_col, label_col) if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} not in {df.columns}")
    return df.select(*(keep or []), F.col(prem_col).alias("premise"),
                     F.col(hyp_col).alias("hypothesis"), F.col(label_col).alias("label"))


def fold_label(label: Column, text_version: Column | None = None) -> Column:
    """PRJ-2: lower-case original labels; paraphrase tables keep theirs as is."""
    if text_version is None:
        return F.lower(label)
    return F.when(text_version == F.lit("original"), F.lower(label)).otherwise(label)


def filter_language(df: DataFrame, lang: str | None = "en", col: str = "language",
                    require: bool = True) -> DataFrame:
    """FLT-1/2: keep one language (pushed to the scan by Catalyst). With no
    language the table is returned as is; a table without the column is an
    error unless ``require=False``."""
    if lang is None:
        return df
    if col not in df.columns:
        if require:
            raise KeyError(f"language filter on a table without column {col!r}")
        return df
    return df.filter(F.col(col) == F.lit(lang))


def choice_to_pairs(df: DataFrame, start: str = "startphrase", endings=("ending1", "ending2"),
                    label: str = "labels", keep: list[str] | None = None) -> DataFrame:
    """PRE-1: one two-choice row -> two pairs, the chosen ending first
    (``entailment``), then the other (``not_entailment``).

    ``labels`` must be 0 or 1 (CHK-1 in plan; the reference wrapped -1)."""
    lab = checked(F.col(label), (0, 1), "choice label")
    ends = F.array(*[F.col(e) for e in endings])
    rows = F.array(
        F.struct(F.lit(0).cast("bigint").alias("choice_no"),
                 F.element_at(ends, (lab + 1).cast("int")).alias("hypothesis"),
                 F.lit(ENTAILMENT).alias("label")),
        F.struct(F.lit(1).cast("bigint").alias("choice_no"),
                 F.element_at(ends, (F.lit(2) - lab).cast("int")).alias("hypothesis"),
                 F.lit(NOT_ENTAILMENT).alias("label")))
    return df.select(*(keep or []), F.col(start).alias("premise"), F.inline(rows))\
             .select(*(keep or []), "choice_no", "premise", "hypothesis", "label")


def union_class_files(frames: dict, label_col: str = "label") -> DataFrame:
    """PRE-2: the class of each row is given by its file; stamp it and append
    (UNION ALL, duplicates kept)."""
    parts = [df.withColumn(label_col, F.lit(lbl)) for lbl, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def collapse_labels(df: DataFrame, col: str, domain, mapping: dict,
                    original_col: str | None = None, lower: bool = True) -> DataFrame:
    """PRE-3/4 core: (lower-case,) check the domain, keep a copy of the
    original label, map onto the binary domain, check again."""
    src = F.lower(F.col(col)) if lower else F.col(col)
    src = checked(src, domain, f"source labels of {col}")
    out = df.withColumn(col, src)
    if original_col:
        out = out.withColumn(original_col, F.col(col))
    case = None
    for k, v in mapping.items():
        case = F.when(F.col(col) == F.lit(k), F.lit(v)) if case is None \
            else case.when(F.col(col) == F.lit(k), F.lit(v))
    mapped = case.otherwise(F.col(col)) if case is not None else F.col(col)
    return out.withColumn(col, checked(mapped, BINARY, f"binary labels of {col}"))


def two_label_to_binary(df: DataFrame, col: str = "label", original_col: str = "label_original") -> DataFrame:
    """PRE-3: entailment / contradiction (any case) -> entailment / not_entailment."""
    return collapse_labels(df, col, TWO_LABELS, {"contradiction": NOT_ENTAILMENT}, original_col)


def three_label_to_binary(df: DataFrame, col: str = "gold_label", language: str | None = "en",
                          original_col: str = "gold_label_original") -> DataFrame:
    """PRE-4: keep one language, then entailment / contradiction / neutral ->
    entailment / not_entailment. (The reference dropped other languages from
    the prepared file; pass ``language=None`` to keep them and filter later.)"""
    return collapse_labels(filter_language(df, language), col, THREE_LABELS,
                           {"contradiction": NOT_ENTAILMENT, "neutral": NOT_ENTAILMENT},
                           original_col, lower=False)
