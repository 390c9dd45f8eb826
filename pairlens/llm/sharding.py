"""Uniform shuffle into shards of exact size (operator 7), DataFrame operations only.

1. Rows are dealt to P logical partitions by a seeded hash, and counted.
2. A P x S communication matrix is drawn: how many rows partition p sends to
   shard s. Rows of a uniform permutation cut into shards of fixed sizes
   give a multivariate hypergeometric law, drawn here cell by cell, so every
   row and column sum is exact. Only the P counts are read by the driver.
3. Each partition permutes its rows (rank by a second seeded hash) and cuts
   the order by its matrix row.
4. Each shard permutes what it received: rows fall into sub-blocks by the
   high bits of a third hash, are ranked within their sub-block, and the
   sub-block's offset makes the slot gapless. No task holds a whole shard.

All randomness is hashed from the seed, the id and the text, so a recomputed
task gives the same rows. P grows with the row count (``rows_per_part``) up to
4096, and P times the shards stays within ``MAX_CELLS``; beyond that, windows
hold more rows each (a 4096th of the table and upwards, sorted with spilling):
at 1000 shards P is 65, and from 32,769 shards on it is 1.

Defined cases: null text counts as empty; null ids are dealt like any value;
equal rows get distinct slots; more shards than rows leaves shards empty; an
empty table gives no rows; other columns of the input are not carried.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Matrix cells that may be sent as a literal table; P is held under it.
MAX_CELLS = 65_536


def draw_hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement: inversion outwards from
    the mode, in steps of the order of the standard deviation, for any size."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    logp = (lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(n - mode + 1)
            - lg(bad - n + mode + 1) - lg(good + bad + 1) + lg(n + 1) + lg(good + bad - n + 1))
    u = rng.random()
    up = down = mode
    p_up = p_down = math.exp(logp)
    u -= p_up
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row sums ``counts``, column sums ``sizes``; law of a uniform permutation."""
    if sum(counts) != sum(sizes):
        raise ValueError("shard sizes must add up to the rows")
    rng, left, out = random.Random(seed), list(sizes), []
    for c in counts:
        row, need, rest = [], c, sum(left)
        for s, cap in enumerate(left):
            rest -= cap
            got = draw_hypergeometric(rng, cap, rest, need)
            row.append(got)
            need -= got
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small constant table."""
    body = ", ".join("(" + ", ".join(str(int(v)) + "L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def shuffle_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 17, rows_per_part: int = 2_000) -> DataFrame:
    """Rows of ``df`` as (id, size, text_crc32, shard, slot): ``size`` is the
    text's UTF-8 bytes plus 1; shard sizes in rows differ by one at most."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_th"))

    def draw(place: int):
        return F.xxhash64(F.lit(seed), F.lit(place), F.col("_id"), F.col("_th"))

    # logical partitions: a power of two of fine buckets is counted once; P is the number that the row count asks for
    fine = 4096
    counted = {r["b"]: r["n"] for r in rows.select(F.pmod(draw(0), F.lit(fine)).alias("b"))
               .groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counted.values())
    parts = max(1, min(fine, MAX_CELLS // shards, 1 << max(0, (total // rows_per_part)).bit_length()))
    counts = [0] * parts
    for b, n in counted.items():
        counts[b % parts] += n
    matrix = communication_matrix(counts, shard_sizes(total, shards), seed)
    cells = []
    for p, row in enumerate(matrix):
        at = 0
        for s, n in enumerate(row):
            if n:
                cells.append((p, s, at, at + n))
            at += n
    cuts = _values(spark, cells or [(-1, 0, 0, 0)], "part, shard, lo, hi")
    bounds = (cuts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard"))).alias("_cuts")))
    local = Window.partitionBy("part").orderBy("_r1", "_id", "_th")
    dealt = (rows.withColumn("part", F.pmod(F.pmod(draw(0), F.lit(fine)), F.lit(parts)).cast("bigint"))
             .withColumn("_r1", draw(1))
             .withColumn("_k", F.row_number().over(local).cast("bigint") - 1)
             .join(F.broadcast(bounds), "part")      # at most MAX_CELLS cells
             .withColumn("shard", F.filter("_cuts", lambda c: (c["lo"] <= F.col("_k")) & (F.col("_k") < c["hi"]))[0]["shard"])
             .select("_id", "size", "text_crc32", "_th", F.col("shard").cast("int").alias("shard"), draw(2).alias("_r2")))
    # the high bits of the third hash choose a sub-block; sub-blocks in order, ranks within
    subs = parts
    dealt = dealt.withColumn("_sub", F.pmod(F.shiftright("_r2", 20), F.lit(subs)).cast("bigint"))
    inner = Window.partitionBy("shard", "_sub").orderBy("_r2", "_id", "_th")
    ranked = dealt.withColumn("_k", F.row_number().over(inner).cast("bigint") - 1)
    offsets = (dealt.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0).cast("bigint"))).select("shard", "_sub", "_off"))
    return (ranked.join(F.broadcast(offsets), ["shard", "_sub"])     # at most MAX_CELLS rows
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("_off") + F.col("_k")).alias("slot")))
