"""Spelling variant grouping by dynamic programming over sorted lists (operator 12).

Words are counted over all texts, and every pair of words one insertion,
deletion or replacement apart is found exactly.

*Lists.* Let m be the length of a pair's shorter word. The words of lengths m
and m + 1 form lists whose rows share the first i and the last j characters;
what lies between is free. At first the free stretch is one half of m: an edit
in one half leaves the other half as it is. A list of more than ``max_list``
rows is dealt anew by halving its free stretch, until lists are small or one
character is free (then the alphabet bounds them). A pair belongs to the one
list in whose free stretch its words first differ, so it is found once.

*Scan.* A task gets its lists sorted behind each other. The edit matrix of a
query against the list has a row for each character of the list's words and,
as only distances up to one count, three cells a row. Rows are computed once
for a shared prefix, which is a range of the sorted list; the least common
prefixes of neighbours say where a range falls apart into those of the next
character. A range all of whose cells exceed one edit is skipped whole. The
scan goes down the ranges for a block of queries together.

*Forms.* A word's form is its near word of largest count (ties: the smallest),
if that is ``ratio`` times as frequent; roots follow forms by pointer
doubling. Each step multiplies the count, so chains are short.

Defined cases: null and empty texts have no words; very long texts are read
whole; a row without an id has its words counted as they stand (no edits are
drawn for it); repeated rows count each time; ties between near words go to
the smaller word; an empty table gives an empty result; other columns of the
input are not carried, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, cut

#: Bytes of text worked on at once, and distinct words a task holds before it passes them on.
SLICE_BYTES, HELD_WORDS = 4 << 20, 200_000
#: Queries that go down the ranges of a list together.
BLOCK_QUERIES = 20_000
#: Re-dealt lists whose keys may be broadcast (about 60 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_LISTS = 100_000
LONG_RUN = 64


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def _run_crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of every run, continued from ``state`` (a crc32); all runs advance together."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    by = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[by], -np.arange(1, min(int(size.max(initial=0)), LONG_RUN) + 1), "right")
    for k, n in enumerate(live.tolist()):
        at = by[:n]
        crc[at] = _CRC[(crc[at] ^ buf[start[at] + k]) & 0xFF] ^ (crc[at] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in by[:int(np.count_nonzero(size > LONG_RUN))].tolist():
        crc[i] = zlib.crc32(buf[start[i] + LONG_RUN:start[i] + size[i]].tobytes(), int(crc[i]))
    return crc


def text_words(ids: list[bytes | None], texts: list[bytes], min_chars: int, noise: int | None) -> pa.Array:
    """The words of ``texts`` (UTF-8), in no order: maximal runs of the letters
    A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``min_chars`` characters
    or more. With ``noise``, a run whose crc32 (of id, colon and run) it
    divides loses the character at crc32 modulo length."""
    buf = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    wide = buf == 0xC3                      # first byte of U+00C0 .. U+00FF
    in_run = _LETTER[buf] | wide
    in_run[1:] |= wide[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    at = np.cumsum([0] + [len(t) for t in texts])
    edge[at] = True
    before = np.concatenate([[False], in_run])
    after = np.concatenate([in_run, [False]])
    start = np.flatnonzero(after & (~before | edge))
    stop = np.flatnonzero(before & (~after | edge))
    chars = stop - start - np.diff(np.concatenate([[0], np.cumsum(wide)])[np.stack([start, stop])], axis=0)[0]
    ok = chars >= min_chars
    start, stop, chars = start[ok], stop[ok], chars[ok]
    changed: list[bytes] = []
    if noise and len(start):
        doc = np.searchsorted(at, start, "right") - 1
        known = np.array([i is not None for i in ids])
        state = np.array([zlib.crc32((i or b"") + b":") for i in ids], np.uint32)
        crc = _run_crc(buf, start, stop - start, state[doc])
        hit = (crc % noise == 0) & known[doc]
        for a, b, h in zip(start[hit].tolist(), stop[hit].tolist(), crc[hit].tolist()):
            run = buf[a:b].tobytes().decode("utf-8")
            i = h % len(run)
            if len(run) > min_chars:
                changed.append((run[:i] + run[i + 1:]).encode("utf-8"))
        start, stop = start[~hit], stop[~hit]
    size = stop - start
    end = np.cumsum(size)
    take = np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(np.append(0, end).astype(np.int64)), pa.py_buffer(buf[take])])
    return pa.concat_arrays([words, pa.array(changed, pa.large_binary())])


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7,
                min_count: int = 2, noise: int | None = None) -> DataFrame:
    """(word, n): the words of all texts (see :func:`text_words`) that occur ``min_count`` times."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            t = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([c.combine_chunks().cast(k) for c, k in
                                               ((t["word"], pa.string()), (t["n_sum"], pa.int64()))], names=["word", "n"])

        for b in batches:
            ids, texts = binary_list(b.column(0)), [t or b"" for t in binary_list(b.column(1))]
            lo = n = 0
            for i in range(len(texts) + 1):
                if i < len(texts) and (i == lo or n + len(texts[i]) <= SLICE_BYTES):
                    n += len(texts[i])
                    continue
                got = pc.value_counts(text_words(ids[lo:i], texts[lo:i], min_chars, noise))
                held.append(pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["word", "n"]))
                size += len(got)
                lo, n = i, len(texts[i]) if i < len(texts) else 0
                if size > 5 * HELD_WORDS:
                    once = flush()
                    held, size = [once.set_column(0, "word", once.column(0).cast(pa.large_binary()))], once.num_rows
                    if size > HELD_WORDS:
                        yield once
                        held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") >= min_count)


def near_in_lists(group: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of one list whose words are one edit apart, both ways.

    Rows are sorted by (list, word): ``group`` numbers the lists, ``code`` holds
    a word's characters from 1 on, 0 behind its end, ``size`` its length.
    A cell is the edits (2: more than one) between a prefix of the list's
    words, as long as the row's depth, and one of the query a character
    shorter, as long, or longer."""
    n, width = code.shape
    rows = np.arange(n)
    # common prefix of each row with the one before; -1 where a list begins
    differ = np.ones((n, width + 1), bool)
    differ[1:, :width] = code[1:] != code[:-1]
    lcp = differ.argmax(1).astype(np.int64)
    lcp[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))] = -1
    starts = [np.flatnonzero(lcp < d) for d in range(width + 1)]        # ranges of one prefix of length d
    padded = np.zeros((n, width + 3), code.dtype)
    padded[:, 1:width + 1] = code                                       # query characters from place 1 on
    found_q, found_r = [], []
    for lo in range(0, n, BLOCK_QUERIES):
        query = rows[lo:lo + BLOCK_QUERIES]
        node = np.searchsorted(starts[0], query, "right") - 1
        short = np.full(len(query), 2, np.int8)
        same, long = np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
        for d in range(width + 1):
            begin = starts[d][node]
            # words that end here
            ends = size[begin] == d
            q, gap = query[ends], size[query[ends]] - d
            cell = np.where(gap == 0, same[ends], np.where(gap == 1, long[ends], np.where(gap == -1, short[ends], 2)))
            hit = cell == 1
            found_q.append(q[hit])
            found_r.append(begin[ends][hit])
            if d == width:
                break
            # the ranges of one more character
            first = np.searchsorted(starts[d + 1], begin)
            after = np.append(starts[d], n)[node + 1]
            many = np.searchsorted(starts[d + 1], after) - first
            total = np.cumsum(many)
            child = np.repeat(first - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)
            of = np.repeat(np.arange(len(query)), many)
            c = code[starts[d + 1][child], d]
            of, child, c = of[c != 0], child[c != 0], c[c != 0]
            query, a, b, e = query[of], short[of], same[of], long[of]
            near = padded[query[:, None], np.arange(d, d + 3)]          # query characters d - 1, d, d + 1 (0-based)
            short = np.minimum(a + (near[:, 0] != c), b + 1)
            same = np.minimum(np.minimum(b + (near[:, 1] != c), e + 1), short + 1)
            long = np.minimum(e + (near[:, 2] != c), same + 1)
            alive = np.minimum(np.minimum(short, same), long) < 2
            query, node = query[alive], child[alive]
            short, same, long = (np.minimum(x[alive], 2).astype(np.int8) for x in (short, same, long))
    return np.concatenate(found_q), np.concatenate(found_r)


_ROW = "m int, i int, j int, head string, tail string, free string, word string, n bigint"
_KEY = ["m", "i", "j", "head", "tail"]


def _deal(words: DataFrame) -> DataFrame:
    """The first lists: for both lengths a pair's shorter word may have, one half or the other free."""
    m, size = F.col("m"), F.length("word")
    half = F.expr("m div 2")
    both = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("m")).filter("m > 0")
    sides = F.array(F.struct(half.alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), (m - half).alias("j")))
    return _keyed(both.select("word", "n", "m", F.inline(sides)))


def _keyed(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("head", F.expr("substring(word, 1, i)"))
            .withColumn("tail", F.expr("substring(word, char_length(word) - j + 1, j)"))
            .withColumn("free", F.expr("substring(word, i + 1, char_length(word) - i - j)"))
            .selectExpr("cast(m AS int) AS m", "cast(i AS int) AS i", "cast(j AS int) AS j", "head", "tail", "free", "word", "n"))


def _halve(rows: DataFrame) -> DataFrame:
    """The lists of ``rows`` by half of their free stretch."""
    h = F.expr("(m - i - j) div 2")
    parts = F.array(F.struct((F.col("i") + h).alias("i"), F.col("j")),
                    F.struct(F.col("i"), (F.col("m") - F.col("i") - h).alias("j")))
    return _keyed(rows.select("word", "n", "m", F.inline(parts.alias("p"))))


def near_pairs(words: DataFrame, max_list: int = 20_000) -> DataFrame:
    """(word, near, near_n): every ordered pair of ``words`` (word, n; words
    distinct) exactly one edit apart."""
    spark = words.sparkSession
    rows, ready = _deal(words), []
    while True:
        big = cut(rows.groupBy(*_KEY).count().filter((F.col("count") > max_list) & (F.col("m") - F.col("i") - F.col("j") > 1))
                  .select(*_KEY, F.lit(True).alias("big")))
        many = big.count()
        if not many:
            ready.append(rows)
            break
        marked = rows.join(F.broadcast(big) if many <= MAX_BROADCAST_LISTS else big, _KEY, "left")
        ready.append(marked.filter("big IS NULL").drop("big"))
        rows = cut(_halve(marked.filter("big").drop("big")))
    lists = reduce(DataFrame.unionByName, ready)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "free")

    def solve(t: pa.Table) -> pa.RecordBatch:
        key = [t[c].to_numpy() for c in ("m", "i", "j")] + [
            pc.dictionary_encode(t[c].combine_chunks()).indices.to_numpy(zero_copy_only=False) for c in ("head", "tail")]
        new = np.ones(len(t), bool)
        new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in key])
        free = t["free"].to_pylist()
        size = np.array([len(x) for x in free], np.int64)
        code = np.zeros((len(t), int(size.max(initial=0))), np.uint32)
        code[np.arange(code.shape[1]) < size[:, None]] = np.frombuffer("".join(free).encode("utf-32-le"), "<u4") + 1
        q, r = near_in_lists(np.cumsum(new), code, size)
        # one of a pair has the length m; with a fixed tail, the words first differ inside the free stretch
        m, i, j = (k.astype(np.int64) for k in key[:3])
        whole = size + i + j
        ok = np.minimum(whole[q], whole[r]) == m[q]
        q, r = q[ok], r[ok]
        if len(q):
            differ = np.ones((len(q), code.shape[1] + 1), bool)
            differ[:, :-1] = code[q] != code[r]
            ok = (j[q] == 0) | (differ.argmax(1) < m[q] - i[q] - j[q])
            q, r = q[ok], r[ok]
        word = t["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(q)), word.take(pa.array(r)),
                                           t["n"].combine_chunks().take(pa.array(r))], names=["word", "near", "near_n"])

    def run(batches):
        """Lists behind each other, whole ones at a time."""
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            held.append(t)
            if sum(map(len, held)) < 2 * BLOCK_QUERIES:
                continue
            t = pa.concat_tables(held)
            last = t.slice(len(t) - 1).select(_KEY).to_pylist()[0]
            same = reduce(pc.and_, [pc.equal(t[c], last[c]) for c in _KEY]).combine_chunks().to_numpy(zero_copy_only=False)
            begin = int(same.argmax())
            if begin:
                yield solve(t.slice(0, begin))
            held = [t.slice(begin)]
        if held and sum(map(len, held)):
            yield solve(pa.concat_tables(held))

    return lists.mapInArrow(run, "word string, near string, near_n bigint")


def with_roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) for a table (word, form): where the forms lead, by pointer
    doubling over the words that have one. Counts grow along a chain, so it
    has no circle."""
    ptr = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        step = cut(ptr.join(ptr.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
                   .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ptr = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return ptr
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def spelling_forms(words: DataFrame, ratio: int = 10, max_list: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    words = cut(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(words, max_list).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    ok = -F.col("best.less") >= ratio * F.col("n")
    forms = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(ok, F.col("best.near")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n")))
    return (forms.join(with_roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
