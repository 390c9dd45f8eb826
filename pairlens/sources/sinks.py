"""Sinks (SNK-1 .. SNK-4).

Parquet partitioned by the run columns is the working store; TSV is an
export that always quotes where needed, so text holding tabs, line breaks or
quotes reads back unchanged (the reference wrote raw f-string rows).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import observed_count
from .readers import missing_path

#: Folders above a run's, and below it.
RUN_COLUMNS = ["dataset", "model", "prompt_type", "text_version"]
RUN_DETAILS = ["paraphrase_source"]
MARKER = "run_id string, attempt string, n_rows bigint"


def run_stamp(now: datetime | None = None) -> str:
    """Run label in the reference's file-name form: day-month-year_H_M_S."""
    return (now or datetime.now(timezone.utc)).strftime("%d-%m-%Y_%H_%M_%S")


def unique_run() -> str:
    """A run label no other run has: the stamp and a random suffix."""
    return f"{run_stamp()}-{uuid.uuid4().hex[:8]}"


def _markers(path: str) -> str:
    return path.rstrip("/") + "-commits"


def _marker_file(spark, path: str, run_id: str):
    """A run's commit marker: the file system it lies in, and its path there."""
    jvm = spark._jvm
    name = hashlib.sha256(run_id.encode("utf-8")).hexdigest()
    where = jvm.org.apache.hadoop.fs.Path(f"{_markers(path)}/{name}.json")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def run_exists(spark, path: str, run_id: str) -> bool:
    """Whether the store at ``path`` holds the run: whether it is committed."""
    fs, marker = _marker_file(spark, path, run_id)
    return fs.exists(marker)


def commits(spark, path: str) -> DataFrame:
    """(run_id, attempt, n_rows) of the committed runs, one row a run."""
    try:
        return spark.read.schema(MARKER).json(_markers(path))
    except Exception as exc:
        if missing_path(exc):
            return spark.createDataFrame([], MARKER)
        raise


def commit_run(spark, path: str, run_id: str, attempt: str, n_rows: int) -> None:
    """Make the rows that ``attempt`` staged the run's, in one step: the
    marker is created only if there is none (an atomic call of the file
    system). Of several writers of a run one gets here first; the others fail,
    and what they staged is never read."""
    fs, marker = _marker_file(spark, path, run_id)
    try:
        out = fs.create(marker, False)
    except Exception as exc:
        if fs.exists(marker):
            raise ValueError(f"run {run_id!r} is already stored in {path}") from exc
        raise
    try:
        out.write(bytearray(json.dumps({"run_id": run_id, "attempt": attempt, "n_rows": n_rows}).encode("utf-8") + b"\n"))
    finally:
        out.close()


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True,
              sep: str = "\t", compression: str = "gzip", rows_per_file: int = 500_000) -> str:
    """SNK-1: quoted TSV with a header (one or more part files). Files are
    compressed, as a pair's text comes once for every run (``compression="none"``:
    plain text). One task reads a compressed file, so each holds at most
    ``rows_per_file`` rows."""
    (df.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", rows_per_file)
       .option("sep", sep).option("header", header)
       .option("quote", '"').option("escape", '"')
       # keep white space at both ends (the writer trims by default); NULL is
       # an unquoted empty field, the empty string a quoted one
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("nullValue", "").option("emptyValue", '""')
       .csv(path))
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> str:
    """Comma-separated variant of SNK-1."""
    return write_tsv(df, path, mode, header, sep=",")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).json(path)
    return path


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 10_000) -> str:
    """JSON files of one list of records each (what SRC-2 reads), at most
    ``rows_per_file`` rows a file: each task closes its lists as rows go by."""
    def lists(batches):
        held = []
        for b in batches:
            for lo in range(0, b.num_rows, rows_per_file):
                held += b.column(0).slice(lo, rows_per_file).to_pylist()
                while len(held) >= rows_per_file:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held[:rows_per_file]) + "]"])], names=["value"])
                    held = held[rows_per_file:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"])], names=["value"])

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lists, "value string")
    rows.write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    return path


def predictions_frame(pred: DataFrame, text_version: str = "original") -> DataFrame:
    """SNK-2 column layout of one text version's predictions: premise,
    hypothesis, gold_label, prediction and, for paraphrases, the paraphrased
    sentence."""
    cols = ["premise", "hypothesis", "gold_label", "prediction"]
    if "text_version" in pred.columns:
        pred = pred.filter(F.col("text_version") == text_version)
    if text_version == "paraphrase":
        cols.append(F.col("original_sentence").alias("paraphrased_sentence"))
    return pred.select(*cols)


def stage_predictions(pred: DataFrame, path: str, run_id: str, partition_cols: list[str] | None = None,
                      mode: str = "append", clustered: bool = False) -> tuple[str, int]:
    """Write a run's rows under an attempt of their own, which no reader takes
    yet. Returns the attempt and its number of rows. ``clustered``: the rows
    already lie together by their folders, and are written as they lie."""
    above = [c for c in (partition_cols or RUN_COLUMNS) if c in pred.columns]
    below = [c for c in RUN_DETAILS if c in pred.columns and c not in above]
    attempt = uuid.uuid4().hex
    counted, seen = observed_count(pred, f"staged-{attempt}")
    out = counted.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
    # cluster rows by their output folder so each task writes few files; AQE
    # splits a skewed folder (one dataset may hold a third of all rows) and
    # merges small ones
    if not clustered:
        out = out.hint("rebalance", *above, "run_id", *below)
    out.write.mode(mode).option("compression", "zstd").partitionBy(*above, "run_id", *below, "attempt").parquet(path)
    return attempt, seen.get["n_rows"]


def write_predictions(pred: DataFrame, path: str, run_id: str | None = None,
                      partition_cols: list[str] | None = None, mode: str = "append") -> str:
    """SNK-2 + SNK-4: the prediction store, partitioned by run columns and a
    run stamp so every run lands in its own folder and readers prune by
    partition. A run's rows are staged, then published by one commit marker:
    a run that fails, or loses against another of its id, leaves nothing that
    :func:`read_predictions` would read."""
    spark = pred.sparkSession
    run_id = run_id or unique_run()
    if run_exists(spark, path, run_id):
        raise ValueError(f"run {run_id!r} is already stored in {path}")
    attempt, n = stage_predictions(pred, path, run_id, partition_cols, mode)
    commit_run(spark, path, run_id, attempt, n)
    return path


def read_predictions(spark, path: str, run_id: str | None = None, schema=None) -> DataFrame:
    """The committed rows of a store: of one run (only its folders are listed
    for reading), or of all. ``schema``: the columns as written, so that
    partition values keep their types."""
    done = commits(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("run_id", T.StringType()),
                                             T.StructField("attempt", T.StringType())]))
    rows = reader.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is None:
        return rows.join(done.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")
    attempt = [r.attempt for r in done.filter(F.col("run_id") == run_id).select("attempt").collect()]    # one row at most
    return rows.filter((F.col("run_id") == run_id) & F.col("attempt").isin(attempt)).drop("attempt")


def paraphrase_frame(df: DataFrame, side: str) -> DataFrame:
    """SNK-3 layout: premise, hypothesis, gold_label, then the replaced
    original as ``original_premise`` or ``original_hypothesis``."""
    if side not in ("p", "h"):
        raise ValueError("side must be 'p' or 'h'")
    last = "original_premise" if side == "p" else "original_hypothesis"
    return df.select("premise", "hypothesis", "gold_label", F.col("original_sentence").alias(last))
