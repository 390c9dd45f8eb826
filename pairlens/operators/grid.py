"""Experiment grid (GRD-1/2) and the allowed-task check (CHK-3).

The reference generated one job per (dataset, model, prompt type). Here the
grid is a small literal list of runs taken from the configuration; each pair
row is expanded over the runs by ``explode`` (a row-local generator, no join
and no shuffle), and ``dataset`` is an ordinary column, so one job renders
every prompt of every dataset.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.prompts import pair_prompt, pair_texts


def run_specs(config: EvalConfig, task: str, models: list[str], prompt_types: list[str] | None = None):
    """Runs = models x prompt types of ``task``; validated against the config."""
    types = prompt_types or config.prompt_types(task)
    specs = []
    for m in models:
        config.model(m)
        for t in types:
            p = config.prompt(task, t)
            specs.append((m, t, p.prefix))
    return specs


def allowed_for(dataset_col: Column, config: EvalConfig, task: str, unknown: str = "error") -> Column:
    """CHK-3 as a predicate: the task is listed for the row's dataset. A
    dataset that the configuration lacks (or a missing name) fails the job;
    ``unknown="keep"`` leaves such rows unrestricted."""
    if unknown not in ("error", "keep"):
        raise ValueError("unknown must be 'error' or 'keep'")
    allowed = [n for n, d in config.datasets.items() if task in d.prompts]
    other = F.lit(True) if unknown == "keep" else F.raise_error(F.concat(
        F.lit("dataset not in the configuration: "), F.coalesce(dataset_col, F.lit("NULL")))).cast("boolean")
    return (F.when(dataset_col.isin(allowed), True)
            .when(dataset_col.isin(list(config.datasets)), False).otherwise(other))


def excluded_datasets(pairs: DataFrame, config: EvalConfig, task: str, dataset_col: str = "dataset") -> DataFrame:
    """CHK-3 as a report: rows per configured dataset that doesn't list the task."""
    barred = [n for n, d in config.datasets.items() if task not in d.prompts]
    return (pairs.filter(F.col(dataset_col).isin(barred)).groupBy(dataset_col)
            .agg(F.count(F.lit(1)).alias("n_excluded")))


def expand_runs(pairs: DataFrame, specs: list[tuple], config: EvalConfig | None = None,
                task: str | None = None, dataset_col: str = "dataset", unknown: str = "error",
                number_col: str | None = None) -> DataFrame:
    """GRD-1: one row per (pair, run) with ``model`` and ``prompt_type``.
    Prefixes stay out of the rows (see :func:`prefix_for`). ``number_col`` adds
    the run's place in ``specs``, from 0; a pair's rows come in that order."""
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("prompt_type"),
                              *([F.lit(i).alias(number_col)] if number_col else []))
                     for i, (m, t, _) in enumerate(specs)])
    out = pairs
    if config is not None and task is not None:
        out = out.filter(allowed_for(F.col(dataset_col), config, task, unknown))
    return (out.withColumn("_run", F.explode(runs))
               .select("*", "_run.model", "_run.prompt_type", *([f"_run.{number_col}"] if number_col else [])).drop("_run"))


def prefix_for(prompt_type: Column, specs: list[tuple]) -> Column:
    """The prompt prefix of a row's prompt type as a CASE over literals, so
    long prefixes are never copied into shuffled rows."""
    expr = None
    for t, p in {t: p for _, t, p in specs}.items():
        expr = F.when(prompt_type == F.lit(t), F.lit(p)) if expr is None \
            else expr.when(prompt_type == F.lit(t), F.lit(p))
    return expr


def grid_prompt(specs: list[tuple], premise: str = "premise", hypothesis: str = "hypothesis") -> Column:
    pt = F.col("prompt_type")
    return pair_prompt(pt, prefix_for(pt, specs), premise, hypothesis)


def grid_texts(specs: list[tuple]) -> list[tuple]:
    """Each run's model and a function that renders its prompts of a batch of
    premises and hypotheses: those of :func:`grid_prompt`."""
    return [(m, partial(pair_texts, t, prefix)) for m, t, prefix in specs]


def render_grid(pairs: DataFrame, specs: list[tuple], config: EvalConfig | None = None,
                task: str = "binary", unknown: str = "error") -> DataFrame:
    """Expand pairs over runs and render the pair prompt of each run. A prompt
    doesn't depend on the model: pairs are expanded over prompt types, rendered,
    and only then expanded over the models that ask each type."""
    models: dict[str, list] = {}
    for m, t, _ in specs:
        models.setdefault(t, []).append(m)
    by_type = F.array(*[F.struct(F.lit(t).alias("prompt_type"), F.array(*map(F.lit, ms)).alias("models"))
                        for t, ms in models.items()])
    if config is not None:
        pairs = pairs.filter(allowed_for(F.col("dataset"), config, task, unknown))
    typed = (pairs.withColumn("_type", F.explode(by_type)).withColumn("prompt_type", F.col("_type.prompt_type"))
             .withColumn("prompt", grid_prompt(specs)))
    return typed.select(*pairs.columns, F.explode("_type.models").alias("model"), "prompt_type", "prompt")
