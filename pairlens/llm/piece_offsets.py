"""SentencePiece encoding with byte offsets, and decoding (operator 11).

A model file gives the normaliser (its compiled character map and white-space
rules) and the BPE pieces. A text is normalised by the longest key of the map
at each place; every byte of the result keeps the byte of the text it came
from, so a piece, which is a stretch of normalised bytes, has its exact span
in the text as given.

Inside tasks the work is done for many texts at once:

* the map's double-array trie is walked for all places of a batch together;
* no piece holds a space after another character (checked when the model is
  loaded), so merges never cross a place where a space follows something
  else: a text falls into *units*, and equal units are encoded once a block;
* all units of a block are merged together, one merge a unit and round: the
  pair of best score, the leftmost among equals, as the library's agenda does.
  Units over ``LONG_UNIT`` characters are cut where no piece holds the two
  characters side by side; what is still longer goes through a heap.

A space is kept as U+0020 inside (the library writes U+2581 for it; both are
the same to the pieces). A character no piece has becomes byte pieces; the
last of them holds the character's span, the others are empty there, as in
the library.

Defined cases: null and empty texts have no pieces; very long texts are worked
through in blocks of units, never cut short; repeated rows and ids are encoded
each for itself; an empty table gives an empty table; the input's other
columns are carried unchanged unless one has an output's name (KeyError).
Models other than BPE with byte fallback, and models with user-defined or
unused pieces, are refused when loaded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import binary_list, byte_cells, slices

SPACE, META = 0x20, "▁".encode()
#: Characters of a unit that is merged among others; longer ones are cut or go through a heap.
LONG_UNIT = 48
#: Units of one block, and bytes of text of one slice (a longer text is a slice of its own).
BLOCK_UNITS, SLICE_BYTES = 400_000, 4 << 20
#: Encoded units a worker keeps (about 200 bytes each); when full, it starts anew.
CACHE_UNITS = 800_000
_UNKNOWN = 1 << 22          # symbol of a character without a piece: _UNKNOWN + code point
_NONE = np.int64(1) << 40   # rank of a pair that is no piece


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 keys whose
    values are places in a block of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64)
        self.texts = blob[4 + size:]

    @staticmethod
    def _offset(u: np.ndarray) -> np.ndarray:
        return (u >> 10) << ((u & 0x200) >> 6)

    def longest(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length (0: none) and value of the longest key that starts at each place of ``at``."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, node = np.arange(len(at)), np.full(len(at), self._offset(self.units[:1])[0])
        depth = 0
        while len(live):
            place = at[live] + depth
            inside = place < len(buf)
            live, node, place = live[inside], node[inside], place[inside]
            byte = buf[place].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            live, node, byte = live[inside], node[inside], byte[inside]
            u = self.units[node]
            hit = (u & 0x800000FF) == byte
            live, node, u = live[hit], node[hit], u[hit]
            node = node ^ self._offset(u)
            depth += 1
            leaf = np.flatnonzero((u >> 8) & 1)
            length[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def text(self, value: int) -> bytes:
        return self.texts[value:self.texts.index(b"\0", value)]


def _metas(buf: np.ndarray) -> np.ndarray:
    """Places of U+2581."""
    if len(buf) < 3:
        return np.empty(0, np.int64)
    return np.flatnonzero((buf[:-2] == META[0]) & (buf[1:-1] == META[1]) & (buf[2:] == META[2]))


class Normalizer:
    """The normaliser of a model: bytes of a text to normalised bytes, with
    the byte of the text that each came from."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        if not spec.escape_whitespaces:
            raise ValueError("a normaliser that doesn't mark spaces is not supported")

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, origin, ends): the normalised bytes of all texts behind each
        other, the byte of its text that each came from, and where each text
        ends. Texts that no rule touches are copied as they are."""
        # U+00FF never occurs in UTF-8: no key crosses it
        buf = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        hits = self._replacements(buf)
        touched = np.searchsorted(hits[0], starts)
        out, origin, ends, n = [], [], [], 0
        for i, t in enumerate(texts):
            lo, hi = int(touched[i]), int(touched[i + 1])
            if t and not self.squeeze and lo == hi:
                lead, tail = (1, 0) if self.dummy and not self.suffix else (0, 1 if self.dummy else 0)
                out.append(b" " * lead + t + b" " * tail)
                origin.append(np.concatenate([np.zeros(lead, np.int64), np.arange(len(t)), np.full(tail, len(t))]))
            elif t:
                got, org = self._one(t, [(int(p - starts[i]), int(k), r) for p, k, r in zip(
                    hits[0][lo:hi], hits[1][lo:hi], hits[2][lo:hi])])
                out.append(got)
                origin.append(org)
            if t:
                n += len(out[-1])
            ends.append(n)
        return (np.frombuffer(b"".join(out), np.uint8), np.concatenate(origin) if origin else np.empty(0, np.int64),
                np.array(ends, np.int64))

    def _replacements(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places, lengths and replacements, in order and without overlap."""
        meta = _metas(buf) if not self.squeeze else np.empty(0, np.int64)
        if self.map is None:
            return meta, np.full(len(meta), 3), [b" "] * len(meta)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        length, value = self.map.longest(buf, at)
        found = {int(p): (3, b" ") for p in meta}
        own = np.flatnonzero(length)
        found |= {int(at[j]): (int(length[j]), self.map.text(int(value[j]))) for j in own}
        places, until = [], 0
        for p in sorted(found):
            if p >= until:
                places.append(p)
                until = p + found[p][0]
        return (np.array(places, np.int64), np.array([found[p][0] for p in places], np.int64), [found[p][1] for p in places])

    def _one(self, t: bytes, hits: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray]:
        """One text with its replacements. A replacement's bytes all come from
        the first byte of its key, the bytes of a copied character likewise."""
        parts, origin, at = [], [], 0
        lead = np.array([b & 0xC0 != 0x80 for b in t], bool) if hits or self.squeeze else np.empty(0, bool)
        char = np.maximum.accumulate(np.where(lead, np.arange(len(t)), 0)) if len(lead) else np.arange(len(t))
        for p, k, r in [*hits, (len(t), 0, b"")]:
            parts += [t[at:p], r]
            origin += [char[at:p], np.full(len(r), p)]
            at = p + k
        got, org = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(origin)
        end = len(t)
        if self.squeeze:
            space = got == SPACE
            keep = ~space | ~np.concatenate([[True], space[:-1]])
            got, org = got[keep], org[keep]
        # U+2581 itself is a space to the pieces, but no space to squeeze
        metas = _metas(got)
        if len(metas):
            got = got.copy()
            got[metas] = SPACE
            keep = np.ones(len(got), bool)
            keep[metas + 1] = keep[metas + 2] = False
            got, org = got[keep], org[keep]
        if self.squeeze:
            n = len(got) - int(np.argmax(np.append(got[::-1] != SPACE, True)))
            if not n:       # nothing but space: no pieces
                return b"", org[:0]
            if n < len(got):
                end, got, org = int(org[n]), got[:n], org[:n]
        got = got.tobytes()
        if self.dummy:
            first, known = 0, {p: (k, r) for p, k, r in hits}
            while self.squeeze and first < len(t):      # behind the spaces dropped at the front
                k, r = known.get(first, (1, t[first:first + 1]))
                if r != b" ":
                    break
                first += k
            got, org = (got + b" ", np.append(org, end)) if self.suffix else (b" " + got, np.insert(org, 0, first))
        self.end = end
        return got, org


class PieceModel:
    """The pieces of a model as tables, and the merges of many units at once."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        with open(path, "rb") as f:
            blob = f.read()
        model = pb.ModelProto()
        model.ParseFromString(blob)
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: not a BPE model with byte fallback")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        text = {i: p.piece.replace("▁", " ") for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(" " in t.lstrip(" ") for t in text.values()):
            raise ValueError(f"{path}: a piece holds a space after another character; texts can't be cut into words")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        n = len(model.pieces)
        symbol = {t: i for i, t in text.items()}
        for c in sorted({c for t in text.values() for c in t}):     # characters only longer pieces hold
            symbol.setdefault(c, n + len(symbol))
        self.size = n
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + _UNKNOWN
        for t, s in symbol.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = s
        self.char_of = {s: t for t, s in symbol.items() if len(t) == 1}
        self.width = np.zeros(n, np.int32)
        for i, t in text.items():
            self.width[i] = len(t.encode())
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in text}, reverse=True))}
        pairs, self.side = {}, set()
        for i, t in text.items():
            self.side |= {t[k:k + 2] for k in range(len(t) - 1)}
            for k in range(1, len(t)):
                if t[:k] in symbol and t[k:] in symbol:
                    pairs[symbol[t[:k]] << 24 | symbol[t[k:]]] = order[model.pieces[i].score] << 24 | i
        self.pairs = pairs
        self.cache: dict[bytes, bytes] = {}
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        digits = [str(i).encode() + b"," for i in range(n)]
        self.digits = np.zeros((n, max(map(len, digits))), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, :len(d)] = np.frombuffer(d, np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Score rank and id of the piece each pair makes, packed; ``_NONE`` where it makes none."""
        key = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], _NONE)

    def merge(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all units (``unit``: ascending unit number of
        each symbol) until no pair of any unit is a piece."""
        done_sym, done_unit = [], []
        best = np.full(len(sym), _NONE)
        if len(sym) > 1:
            same = unit[:-1] == unit[1:]
            best[:-1][same] = self.rank(sym[:-1][same], sym[1:][same])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            count = np.diff(np.append(start, len(sym)))
            least = np.minimum.reduceat(best >> 24, start)
            going = least < (_NONE >> 24)
            if not going.all():
                stay = np.repeat(~going, count)
                done_sym.append(sym[stay])
                done_unit.append(unit[stay])
                sym, unit, best = sym[~stay], unit[~stay], best[~stay]
                if not len(sym):
                    break
                least, count = least[going], count[going]
                start = np.cumsum(count) - count
            hit = np.flatnonzero((best >> 24) == np.repeat(least, count))
            owner = np.searchsorted(start, hit, "right") - 1
            at = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]     # the leftmost of each unit
            sym[at] = (best[at] & 0xFFFFFF).astype(sym.dtype)
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            sym, unit, best, changed = sym[keep], unit[keep], best[keep], np.flatnonzero(changed[keep])
            best[changed] = _NONE
            inner = changed[changed + 1 < len(sym)]
            inner = inner[unit[inner] == unit[inner + 1]]
            best[inner] = self.rank(sym[inner], sym[inner + 1])
        if not done_sym:
            return sym, unit
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        by = np.argsort(unit, kind="stable")
        return sym[by], unit[by]

    def _heap(self, chars: str) -> list[int]:
        """The merges of one long stretch, through a heap."""
        sym = self.symbol_of[np.frombuffer(chars.encode("utf-32-le"), "<u4")].tolist()
        n = len(sym)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list = []

        def offer(i: int, j: int) -> None:
            got = self.pairs.get(sym[i] << 24 | sym[j])
            if got is not None:
                heapq.heappush(heap, (got >> 24, i, j, sym[i], sym[j], got & 0xFFFFFF))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, ok in zip(sym, alive) if ok]

    def _long(self, unit: bytes) -> list[int]:
        """Symbols of a long unit: cut where no piece holds both neighbours."""
        chars, out, at = unit.decode("utf-8"), [], 0
        cuts = [k for k in range(1, len(chars)) if chars[k - 1:k + 1] not in self.side]
        for k in [*cuts, len(chars)]:
            out += self._heap(chars[at:k])
            at = k
        return out

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, width, count): the ids of all units behind each other, the
        normalised bytes each covers, and the number of ids of each unit."""
        text = b"\n".join(units).decode("utf-8")
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        # units may hold line breaks themselves, so their lengths count, not the separators
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        lead = np.cumsum((raw & 0xC0) != 0x80)
        size = np.array([len(u) for u in units], np.int64)
        stop = np.cumsum(size + 1) - 1
        chars = lead[stop - 1] - np.where(stop - size > 0, lead[np.maximum(stop - size - 1, 0)], 0)
        first = np.cumsum(chars + 1) - chars - 1
        long = chars > LONG_UNIT
        index = np.repeat(np.arange(len(units)), np.where(long, 0, chars))
        n = np.where(long, 0, chars)
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        sym, unit = self.merge(self.symbol_of[code[place]].copy(), index)
        extra = np.flatnonzero(long).tolist()
        if extra:
            got = [np.array(self._long(units[i]), np.int32) for i in extra]
            sym = np.concatenate([sym, *got])
            unit = np.concatenate([unit, np.repeat(extra, [len(g) for g in got])])
            by = np.argsort(unit, kind="stable")
            sym, unit = sym[by], unit[by]
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, self.width[sym], np.bincount(unit, minlength=len(units))
        # a character without a piece: a byte piece for each byte, the last with the character's width
        spelled = [self.char_of.get(s, None) or chr(s - _UNKNOWN) for s in sym[odd].tolist()]
        spelled = [c.encode("utf-8") if c != " " else META for c in spelled]
        many = np.ones(len(sym), np.int64)
        many[odd] = [len(b) for b in spelled]
        end = np.cumsum(many)
        ids, width = np.repeat(sym, many), np.zeros(int(end[-1]), np.int32)
        normal = sym < self.size
        width[end[normal] - 1] = self.width[sym[normal]]
        for i, b in zip(odd.tolist(), spelled):
            ids[end[i] - len(b):end[i]] = self.byte_id[np.frombuffer(b, np.uint8)]
            width[end[i] - 1] = 1 if b == META else len(b)
        return ids, width, np.bincount(np.repeat(unit, many), minlength=len(units))

    def known_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`units`, with short units met in earlier blocks looked up."""
        if len(self.cache) + len(units) > CACHE_UNITS:
            self.cache.clear()
        cache = self.cache
        new = [u for u in units if u not in cache]
        if new:
            ids, width, count = self.units(new)
            data, end = np.stack([ids, width], 1).astype(np.int32).tobytes(), (np.cumsum(count) * 8).tolist()
            cells = zip(new, [0, *end], end)
            cache.update((u, data[a:b]) for u, a, b in cells)
        cells = [cache[u] for u in units]
        for u in new:
            if len(u) > 4 * LONG_UNIT:
                del cache[u]
        both = np.frombuffer(b"".join(cells), np.int32).reshape(-1, 2)
        return both[:, 0], both[:, 1], np.fromiter(map(len, cells), np.int64, len(cells)) >> 3

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end, count): the ids of all texts behind each other,
        each piece's span in the bytes of its text, and the ids of each text."""
        buf, origin, ends = self.normalizer.run(texts)
        space = buf == SPACE
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        begin = np.concatenate([[0], ends[:-1]])
        opens[begin[begin < len(buf)]] = True
        start = np.flatnonzero(opens)
        stop = np.append(start[1:], len(buf))
        ids, width, per_unit = [], [], [np.zeros(1, np.int64)]
        for lo in range(0, len(start), BLOCK_UNITS):
            a, b = start[lo:lo + BLOCK_UNITS], stop[lo:lo + BLOCK_UNITS]
            base = int(a[0])
            cells = pa.Array.from_buffers(pa.binary(), len(a), [
                None, pa.py_buffer(np.append(a - base, b[-1] - base).astype(np.int32).tobytes()),
                pa.py_buffer(buf[base:int(b[-1])].tobytes())]).dictionary_encode()
            code = cells.indices.to_numpy(zero_copy_only=False)
            got, w, n = self.known_units(byte_cells(cells.dictionary))
            many = n[code]
            total = np.cumsum(many)
            take = np.repeat((np.cumsum(n) - n)[code] - (total - many), many) + np.arange(int(total[-1]))
            ids.append(got[take])
            width.append(w[take])
            per_unit.append(many)
        if not ids:
            none = np.empty(0, np.int64)
            return none.astype(np.int32), none, none, np.zeros(len(texts), np.int64)
        ids, width = np.concatenate(ids), np.concatenate(width)
        # no unit is in two texts: the pieces of a text are those of the units that start in it
        count = np.diff(np.cumsum(np.concatenate(per_unit))[np.searchsorted(start, np.append(0, ends))])
        until = np.cumsum(width, dtype=np.int64)
        first = origin[until - width]
        last = origin[np.minimum(until, len(origin) - 1)]
        full = np.flatnonzero(count)
        closing = np.cumsum(count)[full] - 1
        last[closing] = self._tail(texts, np.array([len(t) for t in texts], np.int64))[full]
        empty = width == 0
        last[empty] = first[empty]
        return ids, first, last, count

    def _tail(self, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        """Where the last piece of each text ends: before the spaces that are dropped there."""
        if not self.normalizer.squeeze:
            return size
        out = size.copy()
        for i, t in enumerate(texts):
            if t:
                self.normalizer.end = len(t)
                self.normalizer.run([t])
                out[i] = self.normalizer.end
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each with a comma behind it."""
        wide = self.digits[ids]
        return wide[wide != 0].tobytes()


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


OUTPUTS = {"ids": "array<int>", "begins": "array<bigint>", "ends": "array<bigint>", "n_tokens": "bigint",
           "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string", "spans_crc32": "bigint"}


def encode(df: DataFrame, text_col: str = "text", model: str | None = None,
           outputs: tuple[str, ...] = ("ids", "begins", "ends")) -> DataFrame:
    """Add the ``outputs`` (names of ``OUTPUTS``) to every row: ids, the byte
    span of each piece in the text, and digests of them. ``spans_crc32`` is
    the crc32 of begin and end of every piece as little-endian 64-bit integers."""
    clash = [c for c in outputs if c in df.columns]
    if clash:
        raise KeyError(f"the table has columns named as outputs: {clash}")
    path = model or default_model()
    schema = StructType.fromDDL(", ".join(f"`{n}` {OUTPUTS[n]}" for n in outputs))
    full = StructType(df.schema.fields + schema.fields)
    target, at = to_arrow_schema(full), df.columns.index(text_col)
    wants = set(outputs)

    def part(m: PieceModel, texts: list[bytes]) -> dict:
        ids, first, last, count = m.encode(texts)
        end = np.cumsum(count)
        cut = list(zip((end - count).tolist(), end.tolist()))
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(x, t))
        out = {"n_tokens": pa.array(count, pa.int64())}
        if wants & {"ids", "begins", "ends"}:
            out |= {"ids": lists(ids, pa.int32()), "begins": lists(first, pa.int64()), "ends": lists(last, pa.int64())}
        if "ids_sha256" in wants:
            out["ids_sha256"] = pa.array([hashlib.sha256(m.spelled(ids[a:b])[:-1]).hexdigest() for a, b in cut])
        if wants & {"decoded", "decoded_sha256"}:
            said = m.decode([ids[a:b].tolist() for a, b in cut])
            out |= {"decoded": pa.array(said, pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(s.encode("utf-8")).hexdigest() for s in said])}
        if "spans_crc32" in wants:
            spans = np.stack([first, last], 1).astype("<i8")
            out["spans_crc32"] = pa.array([zlib.crc32(spans[a:b].tobytes()) for a, b in cut], pa.int64())
        return out

    def run(batches):
        m = load_model(path)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                rows = b.slice(lo, 4096)
                texts = [t or b"" for t in binary_list(rows.column(at))]
                for i, j in slices(texts, SLICE_BYTES):
                    got = part(m, texts[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [*rows.slice(i, j - i).columns, *(got[n] for n in outputs)], schema=target)

    return df.mapInArrow(run, full)
