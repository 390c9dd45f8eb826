"""Spark session helpers.

The library never creates data on the driver; this module only builds a
session with settings that matter for the evaluation jobs and finds the
shared folder used to cut lineage (checkpoints, stored answers).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "pairlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session tuned for text-pair evaluation.

    * AQE with skew-join splitting and partition coalescing, so the join of
      answers back to pairs survives a hot prompt.
    * Arrow batches for ``mapInPandas`` (the generator hook).
    * No web UI.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # where every partition's build side turns out this small, hash instead of sorting both sides
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_FALLBACK_DIR: dict = {}


def _configured_dir(spark: SparkSession) -> str | None:
    try:
        value = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:
        value = None
    if value:
        return value
    try:  # classic sessions: the context's checkpoint dir, or its conf
        sc = spark.sparkContext
        return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # e.g. Spark Connect: no context on the client
        return None


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Folder shared by the cluster for materialised tables and stores.

    Read from the session (``spark.checkpoint.dir``, or the context's
    checkpoint dir). Only when nothing is configured -- local runs and tests
    -- a private folder is created once and registered as checkpoint dir."""
    base = _configured_dir(spark)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _FALLBACK_DIR.get("dir")
        if base is None:
            base = _FALLBACK_DIR["dir"] = tempfile.mkdtemp(prefix="pairlens-shared-")
            try:
                spark.sparkContext.setCheckpointDir(base)
            except Exception:
                pass
    if parts:
        return "/".join([base.rstrip("/"), *parts])
    return base


def new_shared_subdir(spark: SparkSession, prefix: str) -> str:
    """A fresh, unique sub-folder of :func:`shared_dir`."""
    import uuid
    return shared_dir(spark, f"{prefix}-{os.getpid()}-{uuid.uuid4().hex[:12]}")


def materialize(df, prefix: str):
    """Write ``df`` as Parquet into a fresh folder under the shared folder and
    read it back: one pass, lineage cut (lost executors do not recompute the
    plan), and later branches read only the columns they need."""
    path = new_shared_subdir(df.sparkSession, prefix)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
