"""Analyses behind the reference's stated findings (ANL-1 .. ANL-4):
accuracy sliced by sentence length and lexical overlap, and original
against paraphrased text side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard_of_sets, token_count, token_set
from .metrics import accuracy, correct


FEATURES = ("premise_len", "hypothesis_len", "overlap")


def with_surface_features(df: DataFrame, premise: str = "premise",
                          hypothesis: str = "hypothesis") -> DataFrame:
    """ANL-1/2: token counts of both sentences and their Jaccard overlap.
    Depends on the pair only: compute it on pairs, before they are expanded
    over runs, and carry the three numbers along. Idempotent."""
    if all(c in df.columns for c in FEATURES):
        return df
    # token sets as their own columns: each is built once and read twice
    with_sets = df.withColumn("_ta", token_set(premise)).withColumn("_tb", token_set(hypothesis))
    return (with_sets.withColumn("premise_len", token_count(premise))
                     .withColumn("hypothesis_len", token_count(hypothesis))
                     .withColumn("overlap", jaccard_of_sets("_ta", "_tb"))
                     .drop("_ta", "_tb"))


def length_bin(width: int = 10):
    return F.floor((F.col("premise_len") + F.col("hypothesis_len")) / F.lit(width)).cast("bigint")


def overlap_bin(n_bins: int = 10):
    # overlap is in [0, 1]; 1.0 joins the top bin; NULL (two empty texts) -> -1
    b = F.least(F.floor(F.col("overlap") * F.lit(n_bins)), F.lit(n_bins - 1)).cast("bigint")
    return F.coalesce(b, F.lit(-1).cast("bigint"))


def accuracy_by_length(pred: DataFrame, by: list[str], width: int = 10) -> DataFrame:
    """ANL-3 by length: accuracy per bin of total tokens (premise + hypothesis)."""
    f = with_surface_features(pred).withColumn("length_bin", length_bin(width))
    return accuracy(f, [*by, "length_bin"])


def accuracy_by_overlap(pred: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """ANL-3 by overlap: accuracy per Jaccard decile."""
    f = with_surface_features(pred).withColumn("overlap_bin", overlap_bin(n_bins))
    return accuracy(f, [*by, "overlap_bin"])


def matched_versions(pred: DataFrame, keys: list[str], by: list[str], version_col: str = "text_version") -> DataFrame:
    """ANL-4 on matched pairs: each original prediction is matched to that of
    its paraphrase by ``keys`` (pair and run; null-safe) and counted as right
    or wrong before and after; ``by`` are some of the keys. Rows without a
    partner are counted apart. ``matched_delta`` is the change of accuracy over
    the pairs that have both versions. A pair with several paraphrases counts
    with each (name their source in ``by`` to keep them apart)."""
    original, hit = F.col(version_col) == "original", correct() == 1
    # a key's joined rows are the products of its counts: one aggregate, no join
    per_key = pred.filter(F.col(version_col).isin("original", "paraphrase")).groupBy(*keys).agg(
        F.count_if(original & hit).alias("_or"), F.count_if(original & ~hit).alias("_ow"),
        F.count_if(~original & hit).alias("_pr"), F.count_if(~original & ~hit).alias("_pw"))
    o, p = F.col("_or") + F.col("_ow"), F.col("_pr") + F.col("_pw")
    got = per_key.groupBy(*by).agg(
        F.sum(F.col("_or") * F.col("_pr")).alias("n_right_right"), F.sum(F.col("_or") * F.col("_pw")).alias("n_right_wrong"),
        F.sum(F.col("_ow") * F.col("_pr")).alias("n_wrong_right"), F.sum(F.col("_ow") * F.col("_pw")).alias("n_wrong_wrong"),
        F.sum(F.when(p == 0, o).otherwise(0)).alias("n_only_original"),
        F.sum(F.when(o == 0, p).otherwise(0)).alias("n_only_paraphrase"))
    n = F.col("n_right_right") + F.col("n_right_wrong") + F.col("n_wrong_right") + F.col("n_wrong_wrong")
    return got.withColumn("matched_delta", F.try_divide((F.col("n_wrong_right") - F.col("n_right_wrong")).cast("double"), n))


def original_vs_paraphrase(pred: DataFrame, by: list[str], version_col: str = "text_version") -> DataFrame:
    """ANL-4: accuracy of original and paraphrased text side by side; one
    aggregation pass (pivot over the two known versions), then the delta."""
    versions = ["original", "paraphrase"]
    wide = (pred.groupBy(*by).pivot(version_col, versions)
                .agg(F.count(F.lit(1)).alias("n"), F.sum(correct()).cast("bigint").alias("c")))
    out = wide
    for v in versions:
        out = out.withColumn(f"n_{v}", F.coalesce(F.col(f"{v}_n"), F.lit(0)).cast("bigint"))\
                 .withColumn(f"acc_{v}", F.try_divide(F.col(f"{v}_c").cast("double"),
                                                      F.col(f"{v}_n").cast("double")))
    out = out.withColumn("acc_delta", F.col("acc_paraphrase") - F.col("acc_original"))
    return out.select(*by, "n_original", "n_paraphrase", "acc_original", "acc_paraphrase", "acc_delta")
