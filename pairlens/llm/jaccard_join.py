"""N-gram Jaccard self-join by T-occurrence search (operator 1).

Documents are sets of word shingles; two link when
``q * |x & y| >= p * |x | y|`` (threshold p/q). The result is one row per
document with its class (the smallest id reachable by links) and its number
of links, so no group is expanded into pairs.

1. Sets are fingerprinted in one pass over the texts; equal sets go on as
   one representative with a copy count.
2. Routing signatures. A pair of sizes a <= b that links differs in at most
   D shingles, D fixed by the size class of a. The hash space is cut into
   D + T ranges, so a linked pair agrees on T of them at least; a signature is
   the hash of all shingles in one range. Each set emits the signatures of
   its class and, if a smaller class can reach it, of that one: about 0.3 per
   shingle. This is a T-occurrence problem in itself: a set with fewer than T
   signatures that any other set has is out, and of the others the T - 1 most
   frequent are left out (two sets that share T must share one of the rest).
   So a passage or an empty range that very many documents share routes
   nothing, and no linked pair is lost.
3. Sets that share a signature left are connected; the components are
   blocks, and every link lies inside a block. Each set's text travels once
   to its block's tile. Small blocks share tiles; a block beyond a tile's
   size is split into g parts and each pair of parts is one tile.
4. T-occurrence search in each tile with DivideSkip: inverted lists of the
   tile's shingles; for each set, its lists are divided into L long and the
   rest; the short lists, sorted by document, are merged and documents with
   T - L occurrences kept; these are probed by binary search in the long
   lists until they reach the required overlap or can't any more.
5. Links contract to a forest inside a tile, and the forests of all tiles to
   components.

Defined cases: null and empty texts, and rows with a null id, have no links
(a null id has a null component); a text shorter than a shingle is one
shingle; repeated rows link with each other and share their component; an
empty table gives no rows; other columns of the input are not carried.
Shingles are compared by 64-bit hash, equal sets by 128 bits.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, cut, mix, shingle_set
from .graph import connected_components

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bits of the pre-filters before the two large joins: a fixed 2 MB, whatever the data.
FILTER_BITS = 1 << 24


class Levels:
    """Size classes and their range counts for the threshold p/q."""

    def __init__(self, p: int, q: int, ratio: float = 1.5, top: int = 1 << 30):
        self.p, self.q = p, q
        lows, n = [], 1
        while n < top:
            lows.append(n)
            n = max(n + 1, int(n * ratio))
        ratio_ok = [lo * q // p < hi for lo, hi in zip([x - 1 for x in lows[1:]], lows[2:])]
        assert all(ratio_ok), "a class must reach no further than the next"
        self.lows = np.array(lows, np.int64)
        assert len(lows) <= 64

    def differences(self, level: int) -> int:
        """Most shingles by which a linked pair with its smaller set in ``level`` differs."""
        a = int(self.lows[level + 1]) - 1
        return (a + a * self.q // self.p) * (self.q - self.p) // (self.p + self.q)

    def agree(self, level: int) -> int:
        """T: ranges on which a linked pair of the level agrees at least."""
        return 3 + self.differences(level) // 6

    def of(self, n: int) -> list[tuple[int, int]]:
        """(level, ranges) in which a set of n shingles takes part."""
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        out = []
        for level in (own, own - 1):
            if level < 0 or (level < own and n > (int(self.lows[own]) - 1) * self.q // self.p):
                continue
            d = self.differences(level)
            if d:       # else only equal sets link
                out.append((level, d + self.agree(level)))
        return out


def signatures(s: np.ndarray, levels: Levels) -> np.ndarray:
    """Routing signatures of a sorted set of hashes; the low 6 bits hold the level."""
    out = []
    for level, ranges in levels.of(len(s)):
        place = ((s >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        total = np.zeros(ranges, np.uint64)
        total[place[start].astype(np.int64)] = np.add.reduceat(mix(s + _C3), start)
        own = np.uint64(level * int(_C2) & 0xFFFFFFFFFFFFFFFF)
        sig = mix(total ^ mix(np.arange(ranges, dtype=np.uint64) * _C1 + own))
        out.append((sig & ~np.uint64(63)) | np.uint64(level))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int, levels: Levels) -> DataFrame:
    """(id, n, h1, h2, sigs) per document. Of equal sets met by one task only
    the first carries signatures, so a hot group of copies shrinks before any
    shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                n, h1, h2, sigs = [], [], [], []
                for known, t in zip(b.column(0).is_valid().to_pylist(), binary_list(b.column(1))):
                    s = shingle_set(t, k)
                    a, c = mix(s + _C1).sum(dtype=np.uint64), mix(s ^ _C2).sum(dtype=np.uint64)
                    key = (len(s), int(a), int(c))
                    n.append(len(s))
                    h1.append(a)
                    h2.append(c)
                    new = known and len(s) and key not in seen
                    sigs.append(signatures(s, levels).view(np.int64) if new else None)
                    if new:
                        seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)),
                     pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(sigs, pa.list_(pa.int64()))],
                    names=["id", "n", "h1", "h2", "sigs"])

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, sigs array<bigint>")


def _bit_table(values: DataFrame, col: str) -> DataFrame:
    """The values' hash buckets as a table (word, bits) of at most FILTER_BITS / 64 rows."""
    slot = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    return (values.select(F.shiftright(slot, 6).alias("_word"), F.pmod(slot, F.lit(64)).cast("int").alias("_bit"))
            .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))


def _may_hold(rows: DataFrame, col: str, bits: DataFrame) -> DataFrame:
    """Rows whose bucket is in the table: a filter before a join; never drops a row that joins."""
    slot = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    cols = rows.columns
    return (rows.withColumn("_word", F.shiftright(slot, 6))
            .withColumn("_one", F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({col}), {FILTER_BITS}), 64) as int))"))
            .join(F.broadcast(bits), "_word")       # at most FILTER_BITS / 64 rows
            .filter(F.col("_bits").bitwiseAND(F.col("_one")) != 0).select(*cols))


def candidate_blocks(base: DataFrame, levels: Levels) -> DataFrame:
    """(node, component) of sets that share a routing signature; a node is a set's h1."""
    parts = base.filter("sigs IS NOT NULL").select("h1", F.explode("sigs").alias("sig"))
    shared = cut(parts.groupBy("sig").agg(F.min("h1").alias("m"), F.max("h1").alias("x"), F.count(F.lit(1)).alias("c"))
                 .filter("m < x").select("sig", "c"))
    bits = cut(_bit_table(shared, "sig"))
    least = F.element_at(F.array(*[F.lit(levels.agree(i)) for i in range(len(levels.lows) - 1)]),
                         F.col("level").cast("int") + 1)
    # a set's own signatures of a level, rarest first: all but the T - 1 last
    kept = cut(_may_hold(parts, "sig", bits).join(shared, "sig")
               .groupBy("h1", F.col("sig").bitwiseAND(F.lit(63).cast("bigint")).alias("level"))
               .agg(F.array_sort(F.collect_set(F.struct("c", "sig"))).alias("s"))
               .filter(F.size("s") >= least)
               .select("h1", F.explode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("s"))
               .select("h1", F.col("s.sig").alias("sig")))
    first = cut(kept.groupBy("sig").agg(F.min("h1").alias("m"), F.max("h1").alias("x")).filter("m < x").select("sig", "m"))
    edges = kept.join(first, "sig").filter("h1 <> m").select(F.col("h1").alias("a"), F.col("m").alias("b"))
    return connected_components(edges)


class TileIndex:
    """Inverted lists of the shingles of a tile's sets, and DivideSkip over them."""

    def __init__(self, sets: list[np.ndarray], p: int, q: int, mu: float = 0.0085):
        self.p, self.q, self.mu, self.r = p, q, mu, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(self.r), self.size)
        order = np.argsort(flat, kind="stable")
        h, own = flat[order], owner[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        lid = np.cumsum(first) - 1
        length = np.bincount(lid)
        keep = length[lid] > 1                     # a list of one holds no partner
        lid, own = lid[keep], own[keep]
        ids, lid = np.unique(lid, return_inverse=True)
        self.length = length[ids]
        self.start = np.cumsum(self.length) - self.length
        self.own = own
        self.composite = lid.astype(np.int64) * self.r + own      # sorted: by list, then by document
        by = np.argsort(own, kind="stable")
        self.lists = lid[by]
        self.first = np.searchsorted(own[by], np.arange(self.r + 1))

    def partners(self, x: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Sets after ``x`` (or those ``allowed``) that link with it."""
        p, q, n = self.p, self.q, int(self.size[x])
        least = -(-p * n // q)
        t = -(-p * (n + least) // (p + q))         # least overlap with any partner
        lists = self.lists[self.first[x]:self.first[x + 1]]
        if len(lists) < t:
            return np.empty(0, np.int64)
        length = self.length[lists]
        lists = lists[np.argsort(length, kind="stable")]
        long_n = min(t - 1, int(t / (self.mu * np.log2(length.max() + 1) + 1)))
        short, long = lists[:len(lists) - long_n], lists[len(lists) - long_n:]
        # merge the short lists: runs of one document in the sorted postings
        n_short = self.length[short]
        at = np.repeat(self.start[short] - (np.cumsum(n_short) - n_short), n_short) + np.arange(n_short.sum())
        merged = np.sort(self.own[at], kind="stable")
        run = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        cand, count = merged[run], np.diff(np.concatenate([run, [len(merged)]]))
        size = self.size[cand]
        need = -(-p * (n + size) // (p + q))
        ok = (count >= t - long_n) & (size >= least) & (p * size <= q * n)
        ok &= (cand > x) if allowed is None else allowed[cand]
        cand, count, need = cand[ok], count[ok], need[ok]
        # probe the long lists, shortest first, a few at a time
        for lo in range(0, len(long), 16):
            open_ = count + (len(long) - lo) >= need
            cand, count, need = cand[open_], count[open_], need[open_]
            if not len(cand):
                break
            probe = long[lo:lo + 16, None] * self.r + cand[None, :]
            place = np.searchsorted(self.composite, probe)
            place[place == len(self.composite)] = 0
            count = count + (self.composite[place] == probe).sum(axis=0)
        return cand[count >= need]


def link_tile(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, p: int, q: int):
    """(root, links) of each set in a tile. ``side``: 0 and 1 in a tile of two
    parts, whose links across are wanted; -1 in a tile of its own."""
    index = TileIndex(sets, p, q)
    root = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    across = side[0] >= 0
    allowed = side == 1 if across else None
    for x in (np.flatnonzero(side == 0) if across else range(len(sets))):
        got = index.partners(int(x), allowed)
        if not len(got):
            continue
        links[x] += copies[got].sum()
        links[got] += copies[x]
        for y in got.tolist():
            a, b = find(int(x)), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))], np.int64), links


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, p: int = 85,
                    q: int = 100, tile_rows: int = 1024, tile_shingles: int = 500_000) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document."""
    levels = Levels(p, q)
    base = cut(fingerprints(df, id_col, text_col, k, levels))
    keyed = base.select("id", "n", "h1", "h2")
    reps = cut(keyed.filter("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2")
               .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    blocks = candidate_blocks(base.filter("id IS NOT NULL"), levels)
    members = cut(reps.join(blocks.withColumnRenamed("node", "h1"), "h1")
                  .select("rep", "n", "copies", F.col("component").alias("block")))
    total = members.agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-total // tile_shingles))
    per_block = cut(members.groupBy("block").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_sum"))
                    .select("block", F.greatest(F.ceil(F.col("_rows") / tile_rows),
                                                F.ceil(F.col("_sum") / tile_shingles)).alias("g"))
                    .filter("g > 1"))
    m = members.join(per_block, "block", "left").withColumn("g", F.coalesce("g", F.lit(1).cast("bigint")))
    own = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("g"))
    packed = m.filter("g = 1").select("rep", "n", "copies", F.lit(-1).alias("side"),
                                      F.struct(F.lit(None).cast("bigint").alias("block"),
                                               F.pmod(F.xxhash64(F.lit(2), "block"), F.lit(packs)).alias("i"),
                                               F.lit(0).cast("bigint").alias("j")).alias("tile"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1))
    split = (m.filter("g > 1").withColumn("o", own).withColumn("j", other)
             .select("rep", "n", "copies",
                     F.when(F.col("o") == F.col("j"), -1).when(F.col("o") < F.col("j"), 0).otherwise(1).alias("side"),
                     F.struct("block", F.least("o", "j").alias("i"), F.greatest("o", "j").alias("j")).alias("tile")))
    rows = packed.unionByName(split)
    bits = cut(_bit_table(members, "rep"))
    texts = df.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    texts = _may_hold(texts, "rep", bits).join(members.select("rep"), "rep").dropDuplicates(["rep"])
    tiles = rows.drop("n").join(texts, "rep")

    def search(t: pa.Table) -> pa.Table:
        rep = t.column("rep").to_numpy()
        sets = [shingle_set(x, k) for c in t.column("text").chunks for x in binary_list(c)]
        root, links = link_tile(sets, t.column("side").to_numpy(), t.column("copies").to_numpy(), p, q)
        return pa.table({"a": rep, "b": rep[root], "links": links})

    found = cut(tiles.groupBy("tile").applyInArrow(search, "a bigint, b bigint, links bigint"))
    classes = connected_components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    per_rep = cut(reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
                  .join(links.withColumnRenamed("a", "rep"), "rep", "left")
                  .select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"),
                          (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # documents without shingles or id are linked with nothing
    linked = (keyed.filter("n > 0 AND id IS NOT NULL").join(per_rep, ["n", "h1", "h2"])
              .select("id", "n", "component_id", "n_links"))
    alone = (keyed.filter("n = 0 OR id IS NULL")
             .select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents that stand for their class, all columns as they were: the
    smallest id of each class, one row of it; documents without a class stay."""
    from pyspark.sql import Window
    kept = (jaccard_classes(docs, id_col, text_col, **options).filter(F.col(id_col) == F.col("component_id"))
            .select(F.col(id_col).alias("_keep")).distinct())
    w = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    known = (docs.join(kept, F.col(id_col) == F.col("_keep"), "left_semi")
             .withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row"))
    return known.unionByName(docs.filter(F.col(id_col).isNull()))
