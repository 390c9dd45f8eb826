"""Merkle manifest of a table, with proofs, by lag and lead windows (operator 13).

Every row is a leaf; leaves of a group are a sequence in ascending id, and
``width`` neighbouring nodes make one node of the level above until one is
left, the group's subroot; the subroots in order make the root likewise.

*Places.* Rows are dealt to ranges of (group, id) and written once, sorted. A
row's place in its group is its place in the written part plus the group's
rows in all parts before: one row per part and group is summed, no data row
moves for it. Two rows that agree in group and id are ordered by their leaf.

*Levels.* A block is ``width ** block_levels`` neighbouring leaves. In its
window every level takes lag and lead columns of fixed offsets: a node of
level l sits on its first leaf, so its siblings are l-th powers of ``width``
rows away; the slot in the run masks the lags, the number of nodes left the
leads. The first child's row hashes its parent, and the proofs of the levels
above come down from it by the same lags. A block's topmost node is a leaf of
the next table, ``width ** block_levels`` times smaller, which is worked on
in the same way; its proofs are joined back by block.

A proof is the list of a leaf's levels, lowest first, each the digests before
and after its own in the run; folding it from the leaf's digest gives the root.

Defined cases: a null field is ``-`` in the leaf; null ids come first and null
groups are a group of their own, the first; empty and very long texts are
hashed whole; repeated rows are leaves each; an empty table gives an empty
manifest; columns that are not named are neither hashed nor carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Rows per part and group whose places may be broadcast (about 40 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_PLACES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row: per field ``-`` if null, else UTF-8 byte count, colon, value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return sha(*map(part, fields))


def group_key(group: Column) -> Column:
    """A text that orders and joins as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (with a text column ``g``) plus ``at``, the row's place in its
    group (from 0) by ``order``, and ``size``, the group's rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows alike in every column are told apart by where they were read, so that they can be dealt to several ranges
    keys = ["g", *order, "tie"]
    rows = cut(df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
               .sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).drop("tie"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    counts = cut(rows.groupBy("g", "part").agg(F.min("row").alias("row0"), F.count(F.lit(1)).alias("n")))
    by_part = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "part", (F.coalesce(F.sum("n").over(by_part), F.lit(0)) - F.col("row0")).alias("off"),
                           F.sum("n").over(Window.partitionBy("g")).alias("size"))
    if counts.count() <= MAX_BROADCAST_PLACES:
        starts = F.broadcast(starts)
    return rows.join(starts, ["g", "part"]).withColumn("at", F.col("row") + F.col("off")).drop("part", "row", "off")


def _nodes_left(size: Column, level: int, width: int) -> Column:
    """Nodes of a level over ``size`` leaves."""
    return F.floor((size + F.lit(width ** level - 1)) / F.lit(width ** level)).cast("bigint")


def _run(value: str, level: int, width: int, window, slot: Column) -> tuple[list[Column], list[Column]]:
    """Lag and lead columns of a node's run: entry k - 1 is the sibling k
    places before (null where the slot has none) or after (null behind the
    end, as the block holds no such row)."""
    step = width ** level
    lags = [F.when(slot >= k, F.lag(value, k * step).over(window)) for k in range(1, width)]
    leads = [F.when(slot < width - k, F.lead(value, k * step).over(window)) for k in range(1, width)]
    return lags, leads


def _levels(nodes: DataFrame, width: int, block_levels: int, proofs: bool) -> DataFrame:
    """One block of levels over ``nodes`` (g, at, size, h): adds ``block``, ``top``
    (the block's topmost node, on its first row) and, with ``proofs``, ``path``."""
    df = nodes.withColumn("block", F.floor(F.col("at") / F.lit(width ** block_levels)).cast("bigint"))
    w = Window.partitionBy("g", "block").orderBy("at")
    df = df.withColumn("h0", F.col("h"))
    steps = []
    for level in range(block_levels):
        step = width ** level
        more = _nodes_left(F.col("size"), level, width) > 1          # the level is hashed
        first = (F.col("at") % step) == 0                            # the row holds a node
        slot = F.floor(F.col("at") / step) % width
        lags, leads = _run(f"h{level}", level, width, w, slot)
        name = f"run{level}"
        df = df.withColumn(name, F.when(first & more, F.struct(
            F.concat_ws("", *reversed(lags)).alias("before"), F.concat_ws("", *leads).alias("after"))))
        # the first child's row hashes the parent
        df = df.withColumn(f"h{level + 1}", F.when((F.col("at") % (step * width)) == 0, F.when(
            more, sha(F.col(f"h{level}"), F.col(f"{name}.after"))).otherwise(F.col(f"h{level}"))))
        steps.append(name)
    df = df.withColumn("top", F.col(f"h{block_levels}"))
    if not proofs:
        return df.select(*nodes.columns, "block", "top")
    # proofs come down: a node's levels are its own run and then those of its parent, which sits on the first child's row
    none = F.array().cast("array<struct<before:string,after:string>>")
    df = df.withColumn("path", F.when(F.col("at") % (width ** block_levels) == 0, none))
    for level in reversed(range(block_levels)):
        step = width ** level
        slot = F.floor(F.col("at") / step) % width
        above = F.coalesce(F.when(slot == 0, F.col("path")),
                           *[F.when(slot == k, F.lag("path", k * step).over(w)) for k in range(1, width)])
        own = F.when(F.col(steps[level]).isNotNull(), F.array(steps[level])).otherwise(none)
        df = df.withColumn("path", F.when(F.col("at") % step == 0, F.concat(own, above)))
    return df.select(*nodes.columns, "block", "top", "path")


def proofs(nodes: DataFrame, width: int = 8, block_levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (a text g, at, size and digest h, and any other columns) plus
    ``subroot`` of the group and ``path``, the leaf's proof up to it; and the
    subroots (g, h) alone."""
    biggest = nodes.agg(F.max("size")).first()[0] or 0
    tables = [nodes]
    while biggest > width ** block_levels:
        tops = _levels(tables[-1].select("g", "at", "size", "h"), width, block_levels, False)
        tables.append(cut(tops.filter("top IS NOT NULL").select(
            "g", F.col("block").alias("at"), _nodes_left(F.col("size"), block_levels, width).alias("size"), F.col("top").alias("h"))))
        biggest = -(-biggest // width ** block_levels)
    above = subroots = None
    for table in reversed(tables):
        got = _levels(table, width, block_levels, True)
        if above is None:
            # the last block of levels ends at the subroot, which sits on the group's first row
            one = Window.partitionBy("g", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
            got = got.withColumn("subroot", F.first("top").over(one)).drop("block", "top")
            subroots = cut(got.filter("at = 0").select("g", F.col("subroot").alias("h")))
        else:
            got = (got.drop("top").join(above, ["g", "block"])
                   .withColumn("path", F.concat("path", "path_above")).drop("block", "path_above"))
        if table is not tables[0]:
            above = cut(got.select("g", F.col("at").alias("block"), F.col("path").alias("path_above"), "subroot"))
    return got, subroots


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(path, leaf, lambda h, level: sha(level["before"], h, level["after"]))


def proof_hash(path: Column) -> Column:
    """Digest of a proof: all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] | None = None,
             other: Column | None = None, width: int = 8, block_levels: int = 3) -> DataFrame:
    """Per row of ``df``: ``id``, ``leaf``, ``subroot``, ``root``, ``path`` (the
    proof up to the root) and, if ``other`` is given, its value as ``other``
    (say, a digest to be held against the manifest)."""
    fields = fields or df.columns
    rows = df.select(F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("g"),
                     leaf_hash([F.col(c) for c in fields]).alias("h"),
                     (F.lit(None).cast("string") if other is None else other).alias("other"))
    got, subroots = proofs(placed(rows, ["id", "h"]), width, block_levels)
    # one row a group: the subroots are the leaves of one more sequence
    tops = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("sub"), "h"), ["sub"])
    roots = cut(proofs(tops, width, block_levels)[0].select(
        F.col("sub").alias("g"), F.col("subroot").alias("root"), F.col("path").alias("path_above")))
    if roots.count() <= MAX_BROADCAST_PLACES:
        roots = F.broadcast(roots)
    return got.join(roots, "g").select("id", F.col("h").alias("leaf"), "subroot", "root",
                                       F.concat("path", "path_above").alias("path"), "other")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)
