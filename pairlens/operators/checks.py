"""Data-quality checks (CHK-1 .. CHK-3).

Two forms each:

* *in-plan* assertions (``raise_error`` inside the projection): free at run
  time, fused into the same codegen stage, fail the job on the first bad row;
* *reports*: one small aggregate the caller can inspect or ``enforce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_domain(c: Column, allowed) -> Column:
    # NULL is outside every domain (the reference's isin() is False for NaN)
    return F.coalesce(c.isin(list(allowed)), F.lit(False))


def checked(c: Column, allowed, what: str) -> Column:
    """CHK-1 in plan: ``c`` itself, or a job failure naming the bad value."""
    return F.when(_in_domain(c, allowed), c).otherwise(F.raise_error(F.concat(
        F.lit(f"{what}: value outside {sorted(allowed)}: "),
        F.coalesce(c.cast("string"), F.lit("NULL")))))


def assert_domain(df: DataFrame, col: str, allowed, what: str | None = None) -> DataFrame:
    """CHK-1: every value of ``col`` is in ``allowed`` (NULL fails, empty passes)."""
    return df.withColumn(col, checked(F.col(col), allowed, what or f"label domain of {col}"))


def assert_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Companion of CHK-1 for text columns: a missing sentence fails the job
    instead of being rendered as 'nan' or silently nulling a prompt."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c))
                           .otherwise(F.raise_error(F.lit(f"missing value in column {c}"))))
    return df


def domain_report(df: DataFrame, col: str, allowed, check: str, by: list[str] | None = None) -> DataFrame:
    """CHK-1 as a report: rows per value with an in-domain flag."""
    return (df.groupBy(*(by or []), F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit(check).alias("check"), *(by or []), "value", "n_rows",
                      _in_domain(F.col("value"), allowed).alias("in_domain")))


def domain_reports(stacked: DataFrame, domains: dict) -> DataFrame:
    """CHK-1 reports of several checks in one aggregate, from rows (check, value)."""
    inside = F.lit(False)
    for check, allowed in domains.items():
        inside = F.when(F.col("check") == check, _in_domain(F.col("value"), allowed)).otherwise(inside)
    return (stacked.groupBy("check", "value").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("check", "value", "n_rows", inside.alias("in_domain")))


def enforce(report: DataFrame, flag: str = "ok") -> None:
    """Raise on the driver if any row of a (small) report fails its flag.
    One aggregate action; only the failing count comes back."""
    bad = report.filter(~F.coalesce(F.col(flag), F.lit(False))).count()
    if bad:
        raise AssertionError(f"{bad} failing check row(s)")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """CHK-2 for ALN-1: equal counts do not prove a match, so count the keys
    without a partner on either side (anti-joins both ways)."""
    l_only = left.select(*keys).join(right.select(*keys), keys, "left_anti")
    r_only = right.select(*keys).join(left.select(*keys), keys, "left_anti")
    return (l_only.agg(F.count(F.lit(1)).alias("n")).select(F.lit("left_only").alias("side"), "n")
            .unionByName(r_only.agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("right_only").alias("side"), "n")))


def observed_count(df: DataFrame, name: str):
    """CHK-2 / AGG-3 without an extra pass: attach a row counter to ``df``.
    Returns ``(df, observation)``; the count is known once an action (the
    write of the result) has run: ``observation.get['n_rows']``."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs


def check_conservation(expected: int, actual: int, what: str) -> None:
    """Raise when an operator lost or invented rows."""
    if expected != actual:
        raise AssertionError(f"{what}: expected {expected} rows, got {actual}")


def alignment(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """CHK-2 for ALN-1 in one join: a full outer join of the expected keys
    against the produced keys gives the expected count, the produced count
    and the keys present on one side only (one row)."""
    e = expected.select(*keys, F.lit(1).alias("_e"))
    a = actual.select(*keys, F.lit(1).alias("_a"))
    j = e.join(a, keys, "full_outer")
    return j.agg(F.count("_e").alias("n_expected"), F.count("_a").alias("n_actual"),
                 F.sum(F.when(F.col("_e").isNull() | F.col("_a").isNull(), 1).otherwise(0))
                  .cast("bigint").alias("n_unmatched"))
