"""GEN-2 / GEN-3: reuse an answer across runs of consecutive equal values.

The reference walks the rows in order and calls the generator only when the
sentence (GEN-2) or a supplied id (GEN-3) differs from the previous row's;
otherwise it repeats the previous answer.

A single global ``Window.orderBy`` would put the whole table in one task, and
``partitionBy(dataset)`` one task per dataset (one dataset may hold a third
of all rows). :func:`mark_runs_by_range` deals the rows to ranges of the whole
order tuple instead, whatever its types are: a value of the first order column
that many rows share is split by the columns after it. Each range is walked
once in order and written down; a summary of one row per (partition columns,
range) carries the last value and the number of runs over from range to range,
so a range's first row knows whether it goes on with the run before. Answers
are fetched once per run head and joined back on (range, run): a run spanning
many ranges is fanned out once per range, so no join key is hot.

:func:`mark_runs` does the same without sampling for integral order columns:
rows are cut into *buckets* of consecutive order values
(``order >> bucket_bits``); every bucket holds at most ``2**bucket_bits``
values of the first order column. Where one value may have many rows
and the second order column numbers them, ``sub_bits`` cuts buckets by both
columns. A bucket's first row is compared with the last row of the nearest
non-empty earlier bucket, taken from a per-bucket summary, and run
numbers are offset by a running sum over that summary, scanned in blocks of
buckets, so the only window over a whole dataset sees one row per block.

Null rule: a missing value never equals its predecessor (Python's
NaN != NaN), so each missing value starts its own run.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .generate import answer_requests

B = "_bucket"
#: Bits of a bucket number that count the sub-buckets of one order value.
SUB_WIDTH = 20


def _differs(v: Column, prev: Column) -> Column:
    return F.coalesce(v != prev, F.lit(True))


def _join(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Equi-join on ``cols``. Plain equality keeps the left side's hash
    partitioning on (partition cols, bucket), so the windows before and
    after the join share one shuffle."""
    return left.join(right, cols, "inner")


def _require_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
            F.raise_error(F.lit(f"run detection: NULL in key column {c}"))))
    return df


def _bucket(order_cols: list[str], bucket_bits: int, sub_bits: int | None) -> Column:
    """Bucket number: grows with the order columns, and is bounded in rows by them."""
    first = F.col(order_cols[0]).cast("bigint")
    if sub_bits is None:
        return F.shiftright(first, bucket_bits)
    sub = F.shiftright(F.col(order_cols[1]).cast("bigint"), sub_bits)
    top = 1 << (63 - SUB_WIDTH)
    ok = (sub >= 0) & (sub < 1 << SUB_WIDTH) & (first >= -top) & (first < top)
    return F.when(ok, first * (1 << SUB_WIDTH) + sub).otherwise(
        F.raise_error(F.lit(f"run detection: {order_cols[:2]} out of range for sub_bits={sub_bits}")))


def _prefix(df: DataFrame, P: list[str], key: str, bits: int,
            prev_col: str | None = None, sum_col: str | None = None) -> DataFrame:
    """Ordered scan over rows with a unique integral ``key`` per ``P``:

    * ``_prev``: ``prev_col`` of the row with the next smaller key (NULL for
      the first row);
    * ``_excl``: sum of ``sum_col`` over all rows with a smaller key.

    Rows are grouped into blocks of ``2**bits`` keys: a window per block,
    then a one-row-per-block summary scanned by one window per ``P``, so no
    window task holds more than ``2**bits`` rows or ``n / 2**bits`` block rows.
    """
    blk = "_blk"
    x = df.withColumn(blk, F.shiftright(F.col(key), bits))
    w = Window.partitionBy(*P, blk).orderBy(key)
    aggs = []
    if prev_col:
        x = x.withColumn("_prev_in", F.lag(F.col(prev_col), 1).over(w))\
             .withColumn("_first_in", F.row_number().over(w) == 1)
        aggs.append(F.max_by(F.col(prev_col), F.col(key)).alias("_blast"))
    if sum_col:
        x = x.withColumn("_excl_in", F.coalesce(F.sum(sum_col).over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
        aggs.append(F.sum(sum_col).cast("bigint").alias("_bsum"))
    blocks = x.groupBy(*P, blk).agg(*aggs)
    wb = Window.partitionBy(*P).orderBy(blk)
    if prev_col:
        blocks = blocks.withColumn("_bprev", F.lag("_blast", 1).over(wb))
    if sum_col:
        blocks = blocks.withColumn("_boff", F.coalesce(F.sum("_bsum").over(
            wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    out = x.join(blocks.drop("_blast", "_bsum"), [*P, blk], "inner")
    if prev_col:
        out = out.withColumn("_prev", F.when(F.col("_first_in"), F.col("_bprev"))
                             .otherwise(F.col("_prev_in"))).drop("_prev_in", "_first_in", "_bprev")
    if sum_col:
        out = out.withColumn("_excl", F.col("_boff") + F.col("_excl_in")).drop("_excl_in", "_boff")
    return out.drop(blk)


def mark_runs(df: DataFrame, order_cols: list[str], value_col: str,
              partition_cols: list[str] | None = None, bucket_bits: int = 16,
              keep_bucket: bool = False, block_bits: int | None = None, sub_bits: int | None = None):
    """Add ``is_new`` (run head) and ``run_no`` (1-based within the partition
    columns) to ``df``. ``order_cols[0]`` must be integral; together the order
    columns must be unique within a partition.

    Returns ``(marked, summary)``; ``summary`` has one row per non-empty
    bucket (partition cols, bucket, ``_first_new``, ``_offset``). With
    ``keep_bucket`` the rows keep the bucket and a first-row-of-bucket flag.
    The bucket summary itself is scanned in blocks of ``2**block_bits``
    buckets (default: ``bucket_bits``), see :func:`_prefix`. With ``sub_bits``
    the second order column must be integral and from 0; a bucket then holds one
    value of the first and ``2**sub_bits`` of the second, and a block the
    buckets of ``2**block_bits`` values."""
    P = list(partition_cols or [])
    O = list(order_cols)
    bb = bucket_bits if block_bits is None else block_bits
    if sub_bits is not None:
        bb += SUB_WIDTH
    x = _require_keys(df, [*P, *O[:1 if sub_bits is None else 2]])
    x = x.withColumn(B, _bucket(O, bucket_bits, sub_bits))
    w = Window.partitionBy(*P, B).orderBy(*O)
    prev = F.lag(F.struct(F.col(value_col).alias("v")), 1).over(w)
    x = x.withColumn("_prev", prev)
    x = x.withColumn("_inner_new", F.when(F.col("_prev").isNull(), F.lit(None).cast("boolean"))
                     .otherwise(_differs(F.col(value_col), F.col("_prev.v")))).drop("_prev")

    order_key = F.struct(*[F.col(c) for c in O])
    summary = x.groupBy(*P, B).agg(
        F.min_by(F.struct(F.col(value_col).alias("v")), order_key).alias("_first"),
        F.max_by(F.struct(F.col(value_col).alias("v")), order_key).alias("_last"),
        F.sum(F.when(F.col("_inner_new"), 1).otherwise(0)).cast("bigint").alias("_inner_heads"))
    # previous non-empty bucket's last value, then heads and run offsets
    summary = _prefix(summary, P, B, bb, prev_col="_last")
    summary = (summary
               .withColumn("_first_new", F.when(F.col("_prev").isNull(), F.lit(True))
                           .otherwise(_differs(F.col("_first.v"), F.col("_prev.v"))))
               .withColumn("_heads", F.col("_inner_heads") + F.col("_first_new").cast("bigint"))
               .drop("_prev"))
    summary = _prefix(summary, P, B, bb, sum_col="_heads")\
        .withColumnRenamed("_excl", "_offset").select(*P, B, "_first_new", "_offset")

    marked = _join(x, summary, [*P, B])
    is_new = F.coalesce(F.col("_inner_new"), F.col("_first_new"))
    marked = (marked.withColumn("is_new", is_new)
              .withColumn("run_no", F.col("_offset") + F.sum(F.col("is_new").cast("bigint")).over(
                  w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("_bucket_first", F.col("_inner_new").isNull())
              .drop("_inner_new", "_first_new", "_offset"))
    if not keep_bucket:
        marked = marked.drop(B, "_bucket_first")
    return marked, summary


def _walk(names: list[str], P: list[str], value: str, schema: pa.Schema):
    """Walk a range in order: place, whether a row differs from the one before
    (NULL on the first row of a partition column's rows) and the runs begun
    since that first row."""
    def run(batches):
        from pyspark import TaskContext
        part, place, count, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            def changed(name):
                now = b.column(names.index(name))
                before = pa.concat_arrays([now.slice(0, 1) if last is None else last.column(names.index(name)), now.slice(0, len(now) - 1)])
                return ~pc.fill_null(pc.equal(now, before), False).to_numpy(zero_copy_only=False)
            first = np.zeros(b.num_rows, bool)
            for p in P:
                first |= changed(p)
            first[0] |= last is None
            new = changed(value)
            begun = np.cumsum(new & ~first)
            at = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            k = begun - np.where(at >= 0, begun[at], -count)
            keep = [names.index(f) for f in schema.names[:-4]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(np.full(len(k), part), pa.int32()),
                                              pa.array(place + np.arange(len(k)), pa.int64()),
                                              pa.array(new, pa.bool_(), mask=first), pa.array(k, pa.int64())], schema=schema)
            place, count, last = place + len(k), int(k[-1]), b.slice(len(k) - 1)
    return run


def mark_runs_by_range(df: DataFrame, order_cols: list[str], value_col: str,
                       partition_cols: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``is_new`` (run head) and ``run_no`` (1-based within the partition
    columns) to ``df``, for order columns of any type that sorts; together
    they must be unique within a partition. ``_part`` is the row's range and
    ``_part_first`` says that it is the first there. The result is written
    down: sampled ranges are the same for all that read it."""
    from ..session import materialize
    P, O = list(partition_cols or []), list(order_cols)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = _require_keys(df, [*P, *O[:1]])
    atomic = not isinstance(df.schema[value_col].dataType, (T.StructType, T.ArrayType, T.MapType))
    x = x.withColumn("_v", F.col(value_col) if atomic else F.to_json(F.struct(value_col)))
    x = x.repartitionByRange(n, *P, *O).sortWithinPartitions(*P, *O)
    out = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()),
                        T.StructField("_inner_new", T.BooleanType()), T.StructField("_k", T.LongType())])
    walked = materialize(x.mapInArrow(_walk(x.columns, P, "_v", to_arrow_schema(out)), out), "ranges")
    # one row a range and partition: its last row's place, its first and last value, the runs begun inside
    ends = walked.groupBy(*P, "_part").agg(F.max("_at").alias("_at"), F.max("_k").alias("_inner"))
    value = F.struct(F.col(value_col).alias("v"))
    last = walked.select(*P, "_part", "_at", value.alias("_last")).join(ends, [*P, "_part", "_at"])
    firsts = walked.filter("_inner_new IS NULL").select(*P, "_part", value.alias("_first"))
    parts = firsts.join(last.drop("_at"), [*P, "_part"])
    w = Window.partitionBy(*P).orderBy("_part")
    before = F.lag("_last").over(w)
    parts = parts.withColumn("_first_new", F.when(before.isNull(), True).otherwise(_differs(F.col("_first.v"), before["v"])))
    heads = F.col("_inner") + F.col("_first_new").cast("bigint")
    parts = materialize(parts.select(*P, "_part", "_first_new", F.coalesce(F.sum(heads).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")), "range-summary")
    got = walked.join(parts, [*P, "_part"])
    return (got.withColumn("is_new", F.coalesce("_inner_new", "_first_new"))
            .withColumn("run_no", F.col("_offset") + F.col("_first_new").cast("bigint") + F.col("_k"))
            .withColumn("_part_first", F.col("_inner_new").isNull())
            .drop("_at", "_inner_new", "_k", "_first_new", "_offset"))


def reuse_consecutive(df: DataFrame, factory: Callable, order_cols: list[str], value_col: str,
                      prompt: Column, model: str | None = None,
                      partition_cols: list[str] | None = None, answer_col: str = "raw_answer",
                      bucket_bits: int | None = None, materialize: bool = True,
                      batch_size: int | None = None, partitions: int | None = None,
                      sub_bits: int | None = None) -> DataFrame:
    """Call the generator once per run of consecutive equal ``value_col`` and
    give every row of the run the answer of its head.

    GEN-2: ``value_col`` is the sentence; GEN-3: a supplied id column (the
    prompt is still rendered from the head row's sentence).

    Order columns may be of any type that sorts. ``bucket_bits`` (and
    ``sub_bits``) cut rows of integral order columns by their values instead
    of by sampled ranges, see :func:`mark_runs`; ``materialize`` then writes
    the marked rows once as Parquet into the shared folder, as the ranges are
    always: three branches (requests, fan-out, final join) read them, pruned
    to different columns."""
    P = list(partition_cols or [])
    if bucket_bits is None and sub_bits is None:
        marked = mark_runs_by_range(df, order_cols, value_col, P) \
            .withColumnsRenamed({"_part": B, "_part_first": "_bucket_first"})
    else:
        marked, _ = mark_runs(df, order_cols, value_col, P, 16 if bucket_bits is None else bucket_bits, keep_bucket=True,
                              sub_bits=sub_bits)
        if materialize:
            from ..session import materialize as write_back
            marked = write_back(marked, "runs")
    # the prompt is rendered from the stored inputs, for run heads only
    heads = marked.filter(F.col("is_new")).select(*P, "run_no", F.lit(model).alias("model"),
                                                  prompt.alias("prompt"))
    # a run whose text is missing has no prompt: it keeps a NULL answer, the generator never sees it
    answered = answer_requests(heads.filter(F.col("prompt").isNotNull()), factory, "prompt", "model", answer_col,
                               batch_size, partitions)\
        .select(*P, "run_no", answer_col)
    unasked = heads.filter(F.col("prompt").isNull()).select(*P, "run_no", F.lit(None).cast("string").alias(answer_col))
    answered = answered.unionByName(unasked)
    # buckets (or ranges) each run touches: its head's bucket, plus every later bucket
    # whose first row continues it (carried in from an earlier bucket); a
    # (bucket, run) pair occurs once, so no dedupe is needed
    fan = marked.filter(F.col("is_new") | F.col("_bucket_first")).select(*P, B, "run_no")
    lookup = _join(fan, answered, [*P, "run_no"])
    rows = marked.drop("_bucket_first")
    return _join(rows, lookup, [*P, B, "run_no"]).drop(B)
