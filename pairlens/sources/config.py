"""SRC-7: the evaluation configuration as Spark tables.

The driver-side form is :class:`pairlens.config.EvalConfig` (the file is a
few kilobytes of metadata). This reader gives the same content as tables --
datasets, models, prompts -- read with an explicit schema and exploded from
the nested maps, for joins and reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT = T.StructType([
    T.StructField("preffix", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("label_mapping", T.MapType(T.StringType(), T.StringType())),
])
DATASET = T.StructType([
    T.StructField("data_path", T.StringType()),
    T.StructField("data_path_paraphrase", T.StringType()),
    T.StructField("prem_col", T.StringType()),
    T.StructField("hyp_col", T.StringType()),
    T.StructField("label_col", T.StringType()),
    T.StructField("prompts", T.ArrayType(T.StringType())),
])
CONFIG = T.StructType([
    T.StructField("datasets", T.MapType(T.StringType(), DATASET)),
    T.StructField("models", T.MapType(T.StringType(), T.StringType())),
    T.StructField("prompts", T.MapType(T.StringType(), T.MapType(T.StringType(), PROMPT))),
])


def read_config_tables(spark: SparkSession, path: str, source: bool = False) -> dict[str, DataFrame]:
    """Tables datasets, models and prompts of one configuration file, or of
    many; with ``source`` a column ``config`` names each row's file."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    keep = ["config"] if source else []
    raw = raw.select("*", F.col("_metadata.file_path").alias("config"))
    datasets = raw.select(*keep, F.explode("datasets").alias("dataset", "d")).select(
        *keep, "dataset", "d.data_path", "d.data_path_paraphrase", "d.prem_col", "d.hyp_col",
        "d.label_col", "d.prompts")
    models = raw.select(*keep, F.explode("models").alias("model", "model_id"))
    prompts = (raw.select(*keep, F.explode("prompts").alias("task", "by_type"))
               .select(*keep, "task", F.explode("by_type").alias("prompt_type", "p"))
               .select(*keep, "task", "prompt_type",
                       F.coalesce("p.prefix", "p.preffix").alias("prefix"),
                       F.col("p.label_mapping").alias("label_mapping")))
    return {"datasets": datasets, "models": models, "prompts": prompts}


def run_table(tables: dict[str, DataFrame], task: str | None = None) -> DataFrame:
    """GRD-1 as joined tables: every planned run (config, dataset, task,
    prompt_type, prefix, label_mapping, model, model_id) of the configurations
    read with ``source=True``: each dataset's tasks, their prompts, and all
    models of the same file. Nothing is collected, no name enters the plan."""
    tasks = tables["datasets"].select("config", "dataset", F.explode(F.array_distinct("prompts")).alias("task"))
    prompts = tables["prompts"]
    if task is not None:
        tasks, prompts = tasks.filter(F.col("task") == task), prompts.filter(F.col("task") == task)
    return tasks.join(prompts, ["config", "task"]).join(tables["models"], "config").select(
        "config", "dataset", "task", "prompt_type", "prefix", "label_mapping", "model", "model_id")


def unknown_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(config, dataset, task): tasks that a dataset lists and no prompt has.
    Runs of a task without prompts would silently not be planned."""
    listed = tables["datasets"].select("config", "dataset", F.explode(F.array_distinct("prompts")).alias("task"))
    return listed.join(tables["prompts"].select("config", "task"), ["config", "task"], "left_anti").select("config", "dataset", "task")


def unconfigured(rows: DataFrame, tables: dict[str, DataFrame], dataset_col: str = "dataset") -> DataFrame:
    """(dataset, n_rows): datasets of ``rows`` that no configuration names, a missing name among them."""
    known = tables["datasets"].select(F.col("dataset").alias(dataset_col)).distinct()
    counts = rows.groupBy(dataset_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(known, dataset_col, "left_anti")
