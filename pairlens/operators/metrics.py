"""Aggregations: accuracy (AGG-1/2), row counts (AGG-3), distinct labels (AGG-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correct(gold="gold_label", pred="prediction") -> Column:
    g = F.col(gold) if isinstance(gold, str) else gold
    p = F.col(pred) if isinstance(pred, str) else pred
    # exact string match; NULL on either side is wrong, never dropped
    return F.when(g == p, F.lit(1)).otherwise(F.lit(0))


def accuracy_aggs(gold="gold_label", pred="prediction") -> list[Column]:
    """AGG-1: n_total, n_correct, accuracy = n_correct / n_total (double).

    ``unk`` and NULL predictions count as wrong and stay in the denominator.
    ``try_divide`` gives NULL for an empty group instead of an ANSI error.
    """
    n_total = F.count(F.lit(1))
    n_correct = F.sum(correct(gold, pred)).cast("bigint")
    return [n_total.alias("n_total"), n_correct.alias("n_correct"),
            F.try_divide(n_correct.cast("double"), n_total.cast("double")).alias("accuracy")]


def accuracy(df: DataFrame, by: list[str], gold="gold_label", pred="prediction") -> DataFrame:
    """AGG-2: accuracy per group (partial + final hash aggregate)."""
    return df.groupBy(*by).agg(*accuracy_aggs(gold, pred))


def distinct_labels(df: DataFrame, label_col: str = "gold_label", by: list[str] | None = None) -> DataFrame:
    """AGG-4: the distinct labels (per group)."""
    return df.select(*(by or []), label_col).distinct()
