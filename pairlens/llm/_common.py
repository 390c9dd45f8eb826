"""Helpers shared by the operators: words, hashes, Arrow loops, lineage cuts."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shared_dir

#: White space of every word rule here: U+0020 and U+0009..U+000D (what ``bytes.split`` splits on).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: One odd multiplier per place in a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                  dtype=np.uint64)


def words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words of a UTF-8 text; ``lower`` folds A-Z only."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective): spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in text order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out + h[i:i + n] * _PLACE[i % 8])
    return out


def shingle_set(text: bytes | None, k: int, lower: bool = True, whole_if_short: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles. A text of fewer words
    has its whole word sequence as the one shingle (or none, if not
    ``whole_if_short``); a text without words has none."""
    h = word_hashes(words(text, lower))
    if 0 < len(h) < k:
        return window_hashes(h, len(h)) if whole_if_short else np.empty(0, np.uint64)
    return np.unique(window_hashes(h, k))


def binary_list(col: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def byte_cells(col: pa.Array) -> list[bytes]:
    """The cells of a binary array without nulls (several times as fast as ``to_pylist``)."""
    wide = pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def slices(texts: list[bytes], limit: int):
    """Ranges of neighbouring texts of at most ``limit`` bytes, or one longer text."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > limit:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows: ``fn`` gets the
    columns as Arrow arrays and returns the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                out = fn({n: part.column(i) for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                         for f in target], schema=target)

    return df.mapInArrow(run, st)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's checkpoint folder (shared by all
    executors) and go on from there; Spark's cleaner removes the files when
    the frame is no longer used."""
    shared_dir(df.sparkSession)   # registers a folder where none is set (local runs)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
