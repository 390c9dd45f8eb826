"""Benchmark decontamination by size-partitioned MinHash containment search (operator 8).

A test item of n word shingles is contained in a document when at least
``share`` of them occur there. Items are partitioned by size (powers of two
of n), and each partition has its own MinHash sketch length: the k smallest
shingle hashes (bottom-k MinHash) with k = n_max - ceil(share * n_max) + 1 for
the partition's largest n. At least one sketch value of a contained item
must then occur in the document, so the candidate search loses nothing, and
a document of any length is searched whole. Candidates are verified by exact
shingle containment.

While the items' shingles number at most ``broadcast_shingles``, they travel
to every task and the documents are read once, without a shuffle. Beyond
that, document shingles and sketches meet in a shuffle join, and candidates
are verified by a second join on shingles.

Words are lower-cased (A-Z) runs of non-white-space; shingles are 5 words. An
item of 1 to 4 words is one shingle of its own length, its whole word
sequence; documents are also searched for their runs of the lengths that such
items have. Very common short items condemn many documents: what is a test
item is for its table to say.
Defined cases: null and empty texts and items contain nothing; repeated items and rows each give their own result; null ids
are kept; an empty table gives no rows. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, binary_list, shingle_set, window_hashes, word_hashes, words

BROADCAST_SHINGLES = 1_000_000


def sketch_length(n: int, share: float) -> int:
    """Sketch values that every item of n shingles needs, by its size partition (2^j <= n < 2^(j+1))."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - math.ceil(share * top - 1e-9) + 1)


def document_set(text: bytes | None, k: int, short: list[int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words and of each length in ``short``."""
    h = word_hashes(words(text, True))
    return np.unique(np.concatenate([window_hashes(h, n) for n in (k, *short)]))


def _items(items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(_id, _n, _short, _set) of every item: its shingles, and its number of words if they are fewer than ``k``."""
    def fn(cols):
        texts = binary_list(cols["_text"])
        sets = [shingle_set(t, k).view(np.int64) for t in texts]
        n = [len(words(t)) for t in texts]
        return {"_id": cols["_id"], "_n": [len(s) for s in sets], "_short": [m if 0 < m < k else None for m in n], "_set": sets}

    src = items.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return arrow_map(src, fn, f"_id {src.schema['_id'].dataType.simpleString()}, _n bigint, _short int, _set array<bigint>")


def _documents(df: DataFrame, id_col: str, text_col: str, k: int, short: list[int]) -> DataFrame:
    def fn(cols):
        return {"_id": cols["_id"], "_set": [document_set(t, k, short).view(np.int64) for t in binary_list(cols["_text"])]}

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return arrow_map(src, fn, f"_id {src.schema['_id'].dataType.simpleString()}, _set array<bigint>")


class ItemIndex:
    """Sketches and shingles of all items, as sorted arrays."""

    def __init__(self, ids: list, sets: list[np.ndarray], short: list[int], share: float):
        self.ids, self.short, self.share = ids, short, share
        self.sizes = np.array([len(s) for s in sets], np.int64)
        own = [np.full(len(s), i) for i, s in enumerate(sets)]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.concatenate(own) if own else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.all, self.owner = flat[order], owner[order]
        head = [s[:sketch_length(len(s), share)] for s in sets if len(s)]
        self.sketch = np.unique(np.concatenate(head)) if head else np.empty(0, np.uint64)

    def search(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the items contained in a document's sorted shingle set, and their shingles found."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(doc) or not len(self.sketch):
            return none
        at = np.searchsorted(self.sketch, doc)
        at[at == len(self.sketch)] = 0
        if not (self.sketch[at] == doc).any():
            return none
        lo, hi = np.searchsorted(self.all, doc, "left"), np.searchsorted(self.all, doc, "right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.bincount(self.owner[places], minlength=len(self.sizes))
        hit = np.flatnonzero((found > 0) & (found >= np.ceil(self.share * self.sizes - 1e-9)))
        return hit, found[hit]


def _small_index(items: DataFrame, share: float, limit: int) -> ItemIndex | None:
    """The items as one index if their shingles number at most ``limit`` (read up to the limit only)."""
    total = items.agg(F.sum("_n")).first()[0] or 0
    if total > limit or items.limit(limit + 1).count() > limit:
        return None
    got = items.orderBy("_id").collect()
    return ItemIndex([r["_id"] for r in got], [np.array(r["_set"], np.int64).view(np.uint64) for r in got],
                     sorted({r["_short"] for r in got} - {None}), share)


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
               text_col: str = "text", k: int = 5, share: float = 0.8,
               broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc id, item id, n_item, n_found, containment) for every item contained in a document."""
    wanted = _items(items, item_id, text_col, k)
    index = _small_index(wanted, share, broadcast_shingles)
    d_kind = docs.schema[doc_id].dataType.simpleString()
    i_kind = items.schema[item_id].dataType.simpleString()
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def fn(cols):
            ix, at, hits, n = shared.value, [], [], []
            for i, t in enumerate(binary_list(cols["_text"])):
                h, c = ix.search(document_set(t, k, ix.short))
                at += [i] * len(h)
                hits += h.tolist()
                n += c.tolist()
            return {"_doc": cols["_doc"].take(np.array(at, np.int64)), "_item": [ix.ids[j] for j in hits],
                    "n_item": ix.sizes[np.array(hits, np.int64)], "n_found": n}

        src = docs.select(F.col(doc_id).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
        found = arrow_map(src, fn, f"_doc {d_kind}, _item {i_kind}, n_item bigint, n_found bigint")
    else:
        # a row number stands for each document and item, so that equal and null ids stay apart
        short = sorted(r["_short"] for r in wanted.filter("_short IS NOT NULL").select("_short").distinct().collect())  # k - 1 at most
        own = _documents(docs, doc_id, text_col, k, short).withColumn("_d", F.xxhash64("_id", "_set"))
        top = (F.pow(F.lit(2), F.length(F.bin("_n"))) - 1)
        length = F.least(F.col("_n"), (top - F.ceil(F.lit(share) * top - 1e-9) + 1).cast("bigint")).cast("int")
        marked = wanted.withColumn("_i", F.xxhash64("_id", "_set")).filter("_n > 0")
        # sets come in order of the unsigned hash, so the first values are the sketch
        sketch = marked.select("_i", F.explode(F.slice("_set", F.lit(1), length)).alias("_h"))
        parts = own.select("_d", F.explode("_set").alias("_h"))
        cand = sketch.join(parts, "_h").select("_d", "_i").distinct()
        whole = marked.select("_i", F.explode("_set").alias("_h"))
        counted = (cand.join(whole.dropDuplicates(["_i", "_h"]), "_i").join(parts.distinct(), ["_d", "_h"])
                   .groupBy("_d", "_i").agg(F.count(F.lit(1)).alias("n_found")))
        found = (counted.join(marked.select("_i", F.col("_id").alias("_item"), F.col("_n").alias("n_item")), "_i")
                 .filter(F.col("n_found") >= F.ceil(F.lit(share) * F.col("n_item") - 1e-9))
                 .join(own.select("_d", F.col("_id").alias("_doc")), "_d"))
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "n_item", "n_found",
                        (F.col("n_found") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", k: int = 5, share: float = 0.8,
                      broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """Documents that contain no item, all columns as they were."""
    index = _small_index(_items(items, items.columns[0], text_col, k), share, broadcast_shingles)
    if index is None:
        # texts are told apart by a digest; the rows travel as one column, whatever their names
        digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
        hit = find_items(docs.select(digest.alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"]),
                         items.select(F.col(items.columns[0]).alias("item"), F.col(text_col).alias("text")),
                         "id", "item", "text", k, share, broadcast_shingles).select(F.col("id").alias("key")).distinct()
        rows = docs.select(digest.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        return rows.join(hit, "key", "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    import pyarrow as pa

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(text_col))
            ix = shared.value
            keep = [not len(ix.search(document_set(t, k, ix.short))[0]) for t in binary_list(col)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
