"""A run is published by one marker, or not at all."""

import os
import re

import pytest
from pyspark.sql import functions as F

from pairlens.sources import sinks as K

SCHEMA = "dataset string, model string, prompt_type string, text_version string, paraphrase_source string, prediction string"


def rows(spark, tag, n=40):
    return spark.createDataFrame([(f"0{i % 3}", "m", "t", "paraphrase", f"s{i % 2}", f"{tag}{i}") for i in range(n)], SCHEMA)


def stored(spark, path, run_id=None):
    return sorted(r.prediction for r in K.read_predictions(spark, path, run_id).collect())


def test_a_failing_task_leaves_nothing_readable(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pred")
    K.write_predictions(rows(spark, "a", 2), path, run_id="first")
    broken = rows(spark, "x").repartition(8).withColumn("prediction", F.when(F.col("prediction") == "x7", F.raise_error(
        F.lit("lost"))).otherwise(F.col("prediction")))
    with pytest.raises(Exception, match="lost"):
        K.write_predictions(broken, path, run_id="second")
    assert not K.run_exists(spark, path, "second") and stored(spark, path) == ["a0", "a1"] and stored(spark, path, "second") == []
    K.write_predictions(rows(spark, "b", 3), path, run_id="second")
    assert stored(spark, path, "second") == ["b0", "b1", "b2"] and len(stored(spark, path)) == 5


def test_a_crash_before_the_marker_leaves_nothing_readable(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "pred")
    with monkeypatch.context() as m:
        m.setattr(K, "commit_run", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            K.write_predictions(rows(spark, "x"), path, run_id="r")
    assert spark.read.parquet(path).count() == 40            # staged
    assert stored(spark, path) == [] and not K.run_exists(spark, path, "r")
    K.write_predictions(rows(spark, "y", 4), path, run_id="r")
    assert stored(spark, path, "r") == stored(spark, path) == ["y0", "y1", "y2", "y3"]


def test_of_two_writers_of_one_run_one_wins(spark, tmp_dir, monkeypatch):
    path, own = os.path.join(tmp_dir, "pred"), K.commit_run
    # the second writer starts and ends between the first one's rows and its marker
    def late(spark_, path_, run_id, attempt, n):
        monkeypatch.setattr(K, "commit_run", own)
        K.write_predictions(rows(spark, "second"), path, run_id="r")
        own(spark_, path_, run_id, attempt, n)
    monkeypatch.setattr(K, "commit_run", late)
    with pytest.raises(ValueError, match="already stored"):
        K.write_predictions(rows(spark, "first"), path, run_id="r")
    assert stored(spark, path, "r") == sorted(f"second{i}" for i in range(40)) == stored(spark, path)
    done = K.commits(spark, path).collect()
    assert [(r.run_id, r.n_rows) for r in done] == [("r", 40)]


def test_runs_are_pruned_by_folder_and_keep_their_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pred")
    for run in ("1", "2"):      # names that look like numbers stay texts
        K.write_predictions(rows(spark, run, 6), path, run_id=run)
    df = K.read_predictions(spark, path, "2", rows(spark, "x", 1).schema).filter("paraphrase_source = 's1'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[([^\]]*)", plan).group(1)
    assert all(c in pruned for c in ("run_id", "attempt", "paraphrase_source"))
    assert sorted((r.dataset, r.prediction) for r in df.collect()) == [("00", "23"), ("01", "21"), ("02", "25")]
    assert len(stored(spark, path)) == 12


def test_an_unreadable_marker_is_an_error(spark, tmp_dir):
    path = os.path.join(tmp_dir, "pred")
    with open(path + "-commits", "w") as f:
        f.write("not a folder")
    with pytest.raises(Exception):
        K.write_predictions(rows(spark, "a"), path, run_id="r")
