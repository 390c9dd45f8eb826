"""Token-id files under a Re-Pair grammar (operator 3).

Documents are encoded whole, an end id is appended to each, and ids are
written in ascending order of the document id: rows are dealt to ranges of
the id, sorted there, and cut into shards of about ``shard_tokens`` ids.
Each shard is compressed by Re-Pair: frequent pairs of ids are replaced by
new symbols (nonterminals), round after round; pairs that share no symbol as
left and right don't touch each other's occurrences, so one round replaces a
batch of them at once. It ends when no pair occurs ``min_count`` times. No
pair spans two documents.

File format: Parquet, one row per shard --
  part, shard      order of the shards
  base             number of terminal symbols; rule i defines symbol base + i
  n_tokens         ids in the shard
  rules            little-endian uint32 pairs (left, right) of earlier symbols
  rule_lengths     uint32 expansion length of each rule
  width            bytes per symbol of ``symbols`` (2 or 4)
  symbols          the compressed sequence, little-endian
  doc_ids          ids of the documents, in order
  doc_symbols      uint32 end of each document in ``symbols``
  doc_tokens       uint32 ids of each document (with the end id)
A document is decoded from its own slice of ``symbols`` and the rules alone.

Defined cases: null and empty texts are the end id alone; equal ids go by a
hash of the text, and equal rows are written once each; null ids come first;
a document longer than a shard makes a shard of its own; an empty table
writes no shard; other columns of the input are not carried.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import binary_list, byte_cells, slices

END_ID = 1
BARRIER = 0xFFFFFFFF
MANY = 0xFFFF           # counts of pairs are told apart up to here
#: Shards whose offsets may be broadcast (24 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_SHARDS = 100_000
#: Bytes of text whose words are looked up together (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Pieces that are encoded as one text.
JOINED = 128
_BUCKETS = 20           # bits of the pair-count table at most: about one slot for a place that is counted
_LEFT, _RIGHT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True      # what ``bytes.split`` splits on
#: Bytes by which words are cut into pieces: letters and punctuation whose pre-token doesn't depend on what is beside
#: them. An apostrophe begins a contraction, "<" and "|" a special token; digits and all else stay with their word.
_LETTER, _MARK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{}~")] = _MARK
#: A piece that is one pre-token: marks, or letters up to U+00FF (but the signs U+00D7 and U+00F7).
_ONE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{}~]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _ids_of_words(spec: dict) -> bool:
    """Whether a text's ids are those of its words: the normaliser composes,
    folds white space and lower-cases, and only pieces without white space
    reach the model."""
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    return (steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1].get("content") == " "
            and first.get("behavior") == "Removed" and first.get("invert") is True
            and not any(regex.fullmatch(pattern, w) for w in (" ", "a b", "a ", " a", "\t", "1 2", ". ."))
            and not any(a["normalized"] or a["lstrip"] or a["rstrip"] for a in spec.get("added_tokens", [])))


def _ids_of_pieces(spec: dict) -> bool:
    """Whether a word's ids are those of its letters and of its marks
    (:data:`_CLASS`) apart: the pattern never matches across a letter and a
    mark, and no special token holds such a place."""
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    marks = [bytes([i]).decode() for i in np.flatnonzero(_CLASS == _MARK).tolist()]
    return (pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and all(regex.findall(pattern, f"a{m}b") == ["a", m, "b"] for m in marks)
            and all(re.fullmatch(r"<\|[a-z]+\|>", a["content"]) for a in spec.get("added_tokens", [])))


def pieces(buf: np.ndarray, in_word: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the words in UTF-8 bytes that end in white space; with
    ``cut``, of their pieces: words are cut between a letter and a mark."""
    edge = in_word.copy()
    edge[1:] ^= in_word[:-1]            # where a word begins, and behind its end
    if not cut:
        at = np.flatnonzero(edge)
        return at[::2], at[1::2] - at[::2]
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    start = edge & in_word
    start[1:] |= (kind[1:] ^ kind[:-1]) == _LETTER ^ _MARK
    start = np.flatnonzero(start)
    # a piece ends where the next one begins, or at the white space before
    end = np.append(start[1:], len(buf))
    last = np.append(edge[start[1:]], True)             # the last piece of each word
    end[last] = np.flatnonzero(edge & ~in_word)
    return start, end - start


class WordCachedEncoder:
    """Encodes texts. Where the tokenizer lower-cases, drops white space, and
    keeps letters and punctuation apart (checked in its file), a text's ids are those of its words,
    or of their pieces, so those met before need no second encoding. At most ``cache_words``
    of them are kept (about 200 bytes each); when they are full, all go."""

    def __init__(self, path: str, cache_words: int = 1_000_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.terminals = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("u2" if self.terminals <= 1 << 16 else "u4")
        special = [(t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special]
        spec = json.loads(self.tok.to_str())
        self.by_word = bool(special) and _ids_of_words(spec)
        self.by_piece = self.by_word and _ids_of_pieces(spec)
        #: a special token that parts the words of one call, and its id
        self.part, self.part_id = max(special, default=("", -1))
        #: whether an id ends a pre-token (the model marks it)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.terminals, bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.limit = cache_words
        self._forget()

    def _forget(self) -> None:
        """Words met so far: word -> number; the ids of all behind each other, where each word's begin, how many."""
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 20, self.kind), 0
        self.begin, self.count = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)

    def _encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of distinct words or pieces."""
        one = [_ONE.fullmatch(w) is not None for w in new] if self.by_piece else []
        if not any(one):
            return self._encode_parted(new)
        some = np.array(one)
        got = self._encode_single([w for w, o in zip(new, one) if o])
        if got is None:
            return self._encode_parted(new)
        if some.all():
            return got
        rest = self._encode_parted([w for w, o in zip(new, one) if not o])
        count, own = np.empty(len(new), np.int64), np.empty(len(got[0]) + len(rest[0]), self.kind)
        count[some], count[~some] = got[1], rest[1]
        of = np.repeat(some, count)
        own[of], own[~of] = got[0], rest[0]
        return own, count

    def _encode_single(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, count) of pieces that are one pre-token each, parted by
        spaces: the last id of each is marked. None if the marks don't agree."""
        joined = [b" ".join(new[i:i + JOINED]).decode("utf-8") for i in range(0, len(new), JOINED)]
        cells = [e.ids for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(cells), self.kind)
        ends = np.flatnonzero(self.ends[ids])
        ends_in = np.searchsorted(ends, np.cumsum([len(c) for c in cells]))
        if not np.array_equal(ends_in, np.minimum(np.arange(1, len(cells) + 1) * JOINED, len(new))) or ends[-1] + 1 != len(ids):
            return None
        return ids, np.diff(ends, prepend=-1)

    def _encode_parted(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of distinct words, parted by a special token."""
        odd = [i for i, w in enumerate(new) if b"<|" in w]
        alone = {i: self.tok.encode(new[i].decode("utf-8"), add_special_tokens=False).ids for i in odd}
        plain = [b"" if i in alone else w for i, w in enumerate(new)] if odd else new
        joined = [self.part.join(b"\n".join(plain[i:i + 128]).decode("utf-8").split("\n")) for i in range(0, len(plain), 128)]
        parts = []
        for e in self.tok.encode_batch_fast(joined, add_special_tokens=False):
            parts += [e.ids, [self.part_id]]
        ids = np.fromiter(chain.from_iterable(parts), np.int64)
        ends = np.flatnonzero(ids == self.part_id)
        count = np.diff(ends, prepend=-1) - 1
        if odd:
            cells = np.split(np.delete(ids, ends), np.cumsum(count)[:-1])
            cells = [np.array(alone[i], np.int64) if i in alone else c for i, c in enumerate(cells)]
            return np.concatenate(cells).astype(self.kind), np.array([len(c) for c in cells])
        return np.delete(ids, ends).astype(self.kind), count

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words, encoding those not met yet."""
        if len(self.number) + len(words) > self.limit:
            self._forget()
        known = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(known < 0)
        if not len(unmet):
            return known
        new = [words[i] for i in unmet.tolist()]
        ids, count = self._encode_new(new)
        n, m = len(self.number), len(self.number) + len(new)
        if m > len(self.begin):
            grown = max(m, 2 * len(self.begin))
            self.begin, self.count = np.resize(self.begin, grown), np.resize(self.count, grown)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[n:m] = count
        self.begin[n:m] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.number.update(zip(new, range(n, m)))
        known[unmet] = np.arange(n, m)
        return known

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text: texts are cut into words or pieces behind each
        other, each distinct one is looked up once, and its ids are copied to
        all its places. A tokenizer of another kind encodes whole texts."""
        if not self.by_word:
            whole = self.tok.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.kind) for e in whole]
        # lower-casing could make a special token of a word with "<|"; a capital and a mark (from U+0300 on) must
        # meet NFC before they are lower-cased, as some have a composed form in one case only
        kept = [b"<|" in t for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        for i in np.searchsorted(ends, np.flatnonzero((raw[:-1] - 65 < 26) & (raw[1:] >= 0xCC)), "right").tolist():
            kept[i] = True
        buf = np.frombuffer(b" ".join(t if k else t.lower() for t, k in zip(texts, kept)) + b" ", np.uint8)
        in_word = ~_WHITE[buf]
        start, size = pieces(buf, in_word, self.by_piece)
        if not len(start):
            return [np.empty(0, self.kind) for _ in texts]
        words = pa.Array.from_buffers(pa.binary(), len(start), [     # a slice or one text: under 2 GB
            None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(buf[in_word])]).dictionary_encode()
        number = self._numbers(byte_cells(words.dictionary))[words.indices.to_numpy()]
        many = self.count[number]
        total = np.cumsum(many, dtype=np.int64)
        place = np.int32 if max(int(total[-1]), self.used) < 1 << 30 else np.int64
        ids = self.flat[np.repeat((self.begin[number] - (total - many)).astype(place), many) + np.arange(int(total[-1]), dtype=place)]
        cuts = np.append(0, total)[np.searchsorted(start, ends)]
        return np.split(ids, cuts[:-1])


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> WordCachedEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCachedEncoder(path)


def repair(ids: np.ndarray, base: int, per_round: int = 2048, min_count: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair over ``ids``, in which ``BARRIER`` stands for the end of each
    document and is in no pair, until no pair occurs ``min_count`` times.
    Returns the rules (pairs) and the sequence."""
    seq, rules = ids.astype(np.uint32), []
    # how often the pair at each place may occur at most: its last count (a pair of older symbols only loses
    # occurrences), or MANY beside new symbols. It is the same at all places of a pair, so that those of ``least`` and
    # more, which alone are counted again, hold their pairs whole
    bound = np.full(len(seq), MANY, np.uint16)

    def no_pair_at_ends() -> None:
        ends = np.flatnonzero(seq == BARRIER)
        bound[ends] = 0
        bound[ends[ends > 0] - 1] = 0
        bound[-1:] = 0

    no_pair_at_ends()
    least = min_count
    while True:
        may = np.flatnonzero(bound >= min(least, MANY))
        left, right = seq[may], seq[may + 1]
        bits = max(10, min(_BUCKETS, len(may).bit_length()))
        slot = ((left * _LEFT + right * _RIGHT) >> np.uint32(32 - bits)).astype(np.intp)
        table = np.bincount(slot, minlength=1 << bits).astype(np.int32)
        size = table[slot]
        bound[may] = np.minimum(size, MANY)
        # a pair is in a slot that counts as much at least; the fullest slots go first, all of ``least`` if they hold none
        full = table[table >= least]
        most = int(np.partition(full, -per_round)[-per_round]) if len(full) > per_round else least
        for low in (most, least):
            some = np.flatnonzero(size >= low)
            key = (left[some].astype(np.uint64) << np.uint64(32)) | right[some]
            pairs, counts = np.unique(key, return_counts=True)
            pairs, counts = pairs[counts >= min_count], counts[counts >= min_count]
            if len(pairs) or low <= least:
                break
        if not len(pairs) and least <= min_count:
            break
        least = max(min_count, most // 2)
        if not len(pairs):
            continue
        chosen, lefts, rights = [], set(), set()
        for pair in pairs[np.lexsort((pairs, -counts))[:per_round]].tolist():
            a, b = pair >> 32, pair & 0xFFFFFFFF
            if a in rights or b in lefts or (a == b and (a in lefts or a in rights)):
                continue
            lefts.add(a)
            rights.add(b)
            chosen.append(pair)
        first = base + len(rules)
        rules += [(c >> 32, c & 0xFFFFFFFF) for c in chosen]
        by = np.argsort(np.array(chosen, np.uint64))
        known = np.array(chosen, np.uint64)[by]
        mark = np.zeros(1 << bits, bool)
        mark[((known >> np.uint64(32)).astype(np.uint32) * _LEFT + known.astype(np.uint32) * _RIGHT) >> np.uint32(32 - bits)] = True
        near = np.flatnonzero(mark[slot[some]])
        at, key = may[some[near]], key[near]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        ok = known[place] == key
        at, place = at[ok], place[ok]
        # runs of one id (a == b): every second place of a run of neighbours
        start = np.concatenate([[True], np.diff(at) > 1])
        run = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        same = seq[at] == seq[at + 1]
        take = ~same | (run % 2 == 0)
        at, place = at[take], place[take]
        seq[at] = (first + by[place]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        bound[at] = MANY
        before = at[at > 0] - 1
        before -= ~keep[before]
        bound[before] = MANY
        bound, seq = bound[keep], seq[keep]
        no_pair_at_ends()
    return np.array(rules, np.uint32).reshape(-1, 2), seq


def rule_lengths(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that each rule stands for, and its level (1: of two terminals)."""
    left, right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    length, level = np.ones(base + len(rules), np.int64), np.zeros(base + len(rules), np.int64)
    open_ = np.arange(len(rules))
    # rules of symbols that are done, level by level
    done = np.arange(base + len(rules)) < base
    while len(open_):
        a, b = left[open_], right[open_]
        ready = done[a] & done[b]
        now, a, b = base + open_[ready], a[ready], b[ready]
        length[now] = length[a] + length[b]
        level[now] = 1 + np.maximum(level[a], level[b])
        done[now] = True
        open_ = open_[~ready]
    return length[base:], level[base:]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, offset, length): the ids of symbol s are flat[offset[s]:][:length[s]].
    Rules are written out level by level, all rules of a level at once."""
    own, level = rule_lengths(rules, base)
    length = np.concatenate([np.ones(base, np.int64), own])
    offset = np.cumsum(length) - length
    flat = np.empty(int(length.sum()), np.uint32)
    flat[:base] = np.arange(base, dtype=np.uint32)
    for depth in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == depth)
        parts = rules[at].astype(np.int64).ravel()
        flat[_ranges(offset[base + at], own[at])] = flat[_ranges(offset[parts], length[parts])]
    return flat, offset, length


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] places), then begin[1], ..."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a sequence of symbols."""
    flat, offset, length = table
    return flat[_ranges(offset[symbols], length[symbols])]


SHARD_FIELDS = ("base bigint, n_tokens bigint, rules binary, rule_lengths binary, width int, "
                "symbols binary, doc_symbols binary, doc_tokens binary")


def pack_shard(docs: list[np.ndarray], base: int, **repair_options) -> dict:
    """The columns of one shard but its place and document ids. ``docs``: ids
    of each document, the end id last."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs).astype(np.uint32)
    ids[np.cumsum(sizes) - 1] = BARRIER
    rules, seq = repair(ids, base, **repair_options)
    ends = np.flatnonzero(seq == BARRIER)
    seq[ends] = [d[-1] for d in docs]
    length, _ = rule_lengths(rules, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {"base": base, "n_tokens": len(ids), "rules": rules.astype("<u4").tobytes(),
            "rule_lengths": length.astype("<u4").tobytes(), "width": width,
            "symbols": seq.astype(f"<u{width}").tobytes(),
            "doc_symbols": (ends + 1).astype("<u4").tobytes(),
            "doc_tokens": sizes.astype("<u4").tobytes()}


def _shard_arrays(row: dict):
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
    return rules, symbols, np.frombuffer(row["doc_symbols"], "<u4"), np.frombuffer(row["doc_tokens"], "<u4")


def read_document(row: dict, i: int) -> np.ndarray:
    """Random access: the ids of document ``i`` of a shard row."""
    rules, symbols, ends, _ = _shard_arrays(row)
    part = symbols[(int(ends[i - 1]) if i else 0):int(ends[i])]
    return expand(part, expansions(rules, int(row["base"])))


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, shard_tokens: int = 1_000_000, **repair_options) -> None:
    """Encode ``df`` and write its token files to ``path`` (a folder that all executors reach)."""
    tok = tokenizer or default_tokenizer()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions(F.col("doc_id"), h)
    schema = f"part int, shard int, doc_ids array<{kind.simpleString()}>, {SHARD_FIELDS}"

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        from pyspark import TaskContext
        enc, part, shard = load_encoder(tok), TaskContext.get().partitionId(), 0
        docs, ids, n = [], [], 0
        end = np.array([END_ID], enc.kind)

        def flush():
            row = {"part": part, "shard": shard, "doc_ids": ids} | pack_shard(docs, enc.terminals, **repair_options)
            return pa.RecordBatch.from_pylist([row], schema=target)

        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or b"" for t in binary_list(b.column(1))]
            for lo, hi in slices(texts, SLICE_BYTES):
                for d, got in zip(names[lo:hi], enc.encode(texts[lo:hi])):
                    if docs and n + len(got) + 1 > shard_tokens:
                        yield flush()
                        docs, ids, n, shard = [], [], 0, shard + 1
                    docs.append(np.concatenate([got, end]))
                    ids.append(d)
                    n += len(got) + 1
        if docs:
            yield flush()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "shard", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0).cast("bigint"))
    # one row per range partition: few, whatever the data
    first = per_part.select("part", before("n", Window.orderBy("part")).alias("_first"))
    starts = (sizes.withColumn("_in", before("n_tokens", Window.partitionBy("part").orderBy("shard")))
              .join(first, "part").select("part", "shard", (F.col("_first") + F.col("_in")).alias("start")))
    if sizes.count() <= MAX_BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    placed = files.join(starts, ["part", "shard"])
    kind = files.schema["doc_ids"].dataType.elementType

    schema = f"doc_id {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                rules, symbols, _, sizes = _shard_arrays(row)
                ids = expand(symbols, expansions(rules, int(row["base"]))).astype("<u4")
                end = np.cumsum(sizes.astype(np.int64))
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(end.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], target.field(0).type), pa.array(row["start"] + end - sizes, pa.int64()),
                     pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], schema=target)

    cols = ["start", "base", "rules", "width", "symbols", "doc_symbols", "doc_tokens", "doc_ids"]
    return placed.select(*cols).mapInArrow(run, schema)
