"""Temperature mixing of sources (operator 2).

A source of token share p gets the weight p^a / sum(p^a). The exponent a in
[0, 1] is found by bisection: the smallest a whose epochs of the most
repeated source stay within ``repeat_limit``, or the a whose weights have the
``entropy`` asked for (nats). The budget in tokens, unless given, is the
smallest that takes every source whole at least once.

The weights are realised by block permutations. Documents of a source are
dealt to blocks of about ``block_tokens`` by a seeded hash. A source of x
epochs gives floor(x) whole passes and a part of a last one: blocks in
hashed order while they fit the rest of its budget, and from the block at
the edge documents in hashed order while they fit. ``mix_key`` orders the
blocks of all passes as one permutation; ``mix_place`` orders documents in
a block. Only per-source totals (up to ``max_sources``; beyond, sums are taken
by Spark at each step) reach the driver.

Defined cases: null and empty texts have no tokens and go with their block;
sources without any token are taken once; a null source is a source of its
own; repeated rows count each; an empty table gives no rows; other columns
are carried unchanged, the new ones are prefixed ``mix_``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, cut


class Shares:
    """Sums over the sources' token shares p, for any exponent."""

    def __init__(self, totals: DataFrame, max_sources: int):
        """``totals``: one row per source with its ``_t`` tokens."""
        live = totals.filter("_t > 0")
        head = live.agg(F.sum("_t"), F.count(F.lit(1))).first()
        self.tokens, self.n = int(head[0] or 0), int(head[1])
        self.frame, self.p = None, None
        if self.n <= max_sources:
            self.p = np.sort(np.array([r[0] for r in live.select("_t").collect()], float)) / max(1, self.tokens)
        else:
            self.frame = cut(live.select((F.col("_t") / self.tokens).alias("p")))
            low, high = self.frame.agg(F.min("p"), F.max("p")).first()
            self.low, self.high = low, high
        if self.p is not None and self.n:
            self.low, self.high = float(self.p[0]), float(self.p[-1])

    def sums(self, a: float) -> tuple[float, float]:
        """sum(p^a) and sum(p^a * log p)."""
        if self.p is not None:
            w = self.p ** a
            return float(w.sum()), float((w * np.log(self.p)).sum())
        w = F.pow(F.col("p"), F.lit(a))
        return tuple(self.frame.agg(F.sum(w), F.sum(w * F.log("p"))).first())

    def entropy(self, a: float) -> float:
        z, s = self.sums(a)
        return math.log(z) - a * s / z

    def spread(self, a: float) -> float:
        """Epochs of the most repeated source when the least repeated is taken once."""
        return (self.low / self.high) ** (a - 1)


def bisect(ok, steps: int = 60) -> float:
    """Smallest a in [0, 1] with ``ok(a)``, for an ``ok`` that stays true; 1 if none."""
    if ok(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def mix_sources(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                repeat_limit: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
                block_tokens: int = 1_000_000, seed: int = 23, max_sources: int = 10_000) -> DataFrame:
    """Rows of ``df``, each as often as its source's weight asks, plus
    mix_tokens, mix_epoch, mix_block, mix_key and mix_place."""
    if (repeat_limit is None) == (entropy is None):
        raise ValueError("name a repetition limit or an entropy")
    src = F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000"))
    rows = (df.withColumn("_s", src)
            .withColumn("mix_tokens", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint"))
            .withColumn("mix_place", F.xxhash64(F.lit(seed), F.lit(1), F.col(id_col), F.length(text_col))))
    slim = cut(rows.select("_s", "mix_tokens", "mix_place"))
    totals = cut(slim.groupBy("_s").agg(F.sum("mix_tokens").alias("_t")))
    shares = Shares(totals, max_sources)
    if shares.n:
        if repeat_limit is not None:
            a = bisect(lambda x: shares.spread(x) <= repeat_limit)
        else:
            a = bisect(lambda x: shares.entropy(x) <= entropy)
        z = shares.sums(a)[0]
        least = shares.high ** (a - 1) / z               # epochs per budget of the least repeated source
        tokens = budget if budget is not None else shares.tokens / least
    else:
        a, z, tokens = 1.0, 1.0, 0.0
    p = F.col("_t") / F.lit(float(max(1, shares.tokens)))
    epochs = F.when(F.col("_t") > 0, F.pow(p, F.lit(a - 1)) / F.lit(z) * F.lit(float(tokens) / max(1, shares.tokens)))
    plan = (totals.withColumn("_x", F.coalesce(epochs, F.lit(1.0)))
            .withColumn("_full", F.floor(F.col("_x") + 1e-9))
            .withColumn("_rest", F.greatest(F.lit(0.0), F.col("_x") - F.col("_full")) * F.col("_t"))
            .withColumn("_rest", F.when(F.col("_rest") > 1e-6 * F.col("_t"), F.floor(F.col("_rest"))).otherwise(0))
            .withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_t") / block_tokens)))
            .select("_s", "_full", "_rest", "_blocks"))
    if totals.count() <= max_sources:
        plan = F.broadcast(plan)           # at most max_sources rows
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "mix_place"), F.col("_blocks"))
    key = lambda epoch: F.xxhash64(F.lit(seed), F.lit(3), "_s", epoch, "mix_block")
    # the last, partial pass: blocks in the order of that pass's permutation
    sized = (slim.join(plan, "_s").withColumn("mix_block", block).groupBy("_s", "mix_block", "_full", "_rest")
             .agg(F.sum("mix_tokens").alias("_n")))
    upto = Window.partitionBy("_s").orderBy(key(F.col("_full")), "mix_block")
    last = cut(sized.withColumn("_end", F.sum("_n").over(upto)).withColumn("_left", F.col("_rest") - (F.col("_end") - F.col("_n")))
               .withColumn("_take", F.when((F.col("_rest") > 0) & (F.col("_left") >= F.col("_n")), 2)
                           .when((F.col("_rest") > 0) & (F.col("_left") > 0), 1).otherwise(0))
               .select("_s", "mix_block", "_full", "_left", "_take"))
    placed = rows.join(plan.select("_s", "_blocks"), "_s").withColumn("mix_block", block).drop("_blocks")
    placed = placed.join(last, ["_s", "mix_block"])
    within = Window.partitionBy("_s", "mix_block").orderBy("mix_place", F.col(id_col)).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.when(F.col("_take") == 2, True).when(F.col("_take") == 1, F.sum("mix_tokens").over(within) <= F.col("_left")) \
        .otherwise(False)
    n = F.col("_full") + F.col("_fits").cast("bigint")
    out = (placed.withColumn("_fits", fits).filter(n > 0)
           .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
           .withColumn("mix_key", key(F.col("mix_epoch"))))
    return out.select(*df.columns, "mix_tokens", "mix_epoch", "mix_block", "mix_key", "mix_place")
