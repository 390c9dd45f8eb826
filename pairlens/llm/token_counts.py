"""Token counts by section (operator 6): encode a whole document once, map
every token to its character span, and attribute tokens to the sections
their spans lie in.

Sections tile the text: by default each line with the line break that ends
it. Token spans and section spans are both sorted, so the interval join is a
merge of two sorted lists per document. A token that crosses a boundary goes
whole to the section that holds most of its bytes; of equal shares, to the
first. So the counts of a document's sections add up to its tokens.

Defined cases: null and empty texts have one section (0) of no characters
and no tokens; null ids are kept; repeated rows keep rows of their own; an
empty table gives no rows; other columns of the input are not carried.
Spans of tokens that end inside a character count in characters begun.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def load_encoder(path: str):
    """(encode, byte length by id) of a rank file."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return enc.encode_ordinary, size


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which sections start: 0 and after every line break but a last one."""
    after = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], after[after < len(data)]]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and boundary-crossing tokens, of each section. ``ends``: byte
    ends of the tokens, which tile the text; ``starts``: of the sections."""
    n = len(starts)
    if not len(ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    stop = np.concatenate([starts[1:], [total]])
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    best = first.copy()
    cross = np.flatnonzero(last > first)
    for t in cross:      # few: a token spans a boundary only at line breaks
        share = np.minimum(stop[first[t]:last[t] + 1], ends[t]) - np.maximum(starts[first[t]:last[t] + 1], begin[t])
        best[t] = first[t] + int(np.argmax(share))
    return np.bincount(best, minlength=n), np.bincount(best[cross], minlength=n)


def section_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str | None = None) -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, n_crossing) per line of each text."""
    path = vocabulary or default_vocabulary()

    def fn(cols):
        encode, size = load_encoder(path)
        at, out = [], {k: [] for k in ("section", "start_char", "end_char", "n_tokens", "n_crossing")}
        for i, text in enumerate(cols["_text"].to_pylist()):
            text = text or ""
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            starts = line_starts(data)
            ends = np.cumsum(size[np.array(encode(text), np.int64)])
            n, crossing = attribute(ends, starts, len(data))
            at.append(np.full(len(starts), i))
            out["section"].append(np.arange(len(starts)))
            out["start_char"].append(chars[starts])
            out["end_char"].append(chars[np.concatenate([starts[1:], [len(data)]])])
            out["n_tokens"].append(n)
            out["n_crossing"].append(crossing)
        return {id_col: cols[id_col].take(np.concatenate(at))} | {
            k: np.concatenate(v).astype(np.int64) for k, v in out.items()}

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    return arrow_map(src, fn, f"`{id_col}` {kind}, section bigint, start_char bigint, end_char bigint, "
                              "n_tokens bigint, n_crossing bigint")
