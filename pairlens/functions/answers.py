"""Turning free-text generator answers into labels or clean sentences.

TXT-5 ``answer_to_label``: lower-case, split on white space, strip ``.``
and ``,`` from both ends of each token; the first token that is a key of
the label mapping gives the label, otherwise ``unk``.

TXT-6 ``clean_paraphrase``: first line; delete every run of digits together
with the character after it; keep the text before the first full stop;
strip white space.

Both are pure column expressions (Java regex written to match Python's
string semantics), so they also apply to streaming DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNKNOWN
from .text import EDGE_WS, UNICODE, WS, WS_RUN

TOKEN_EDGE = r"^[.,]+|[.,]+$"
# str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
NUMBERING = r"[0-9]+."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map_literal(mapping: dict) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _regex_safe(mapping: dict) -> bool:
    """Keys the single-regex path can match exactly: non-empty, no white
    space, not starting or ending with '.' or ','. Other keys either can
    never match or need the token-array path."""
    for k in mapping:
        if not k or re.search(r"\s", k) or k[0] in ".," or k[-1] in ".,":
            return False
    return True


def answer_to_label(answer, mapping, unknown: str = UNKNOWN) -> Column:
    """TXT-5 for one mapping (a dict literal or a ``map<string,string>`` column)."""
    text = F.lower(_col(answer))
    if isinstance(mapping, dict) and mapping and _regex_safe(mapping):
        # One left-to-right regex scan: a token is white space (or the start),
        # optional dots/commas, a key, optional dots/commas, then white space
        # or the end. The leftmost match is the first qualifying token.
        keys = "|".join(re.escape(k) for k in sorted(mapping, key=len, reverse=True))
        pattern = UNICODE + rf"(?:^|{WS})[.,]*({keys})[.,]*(?={WS}|\z)"
        hit = F.regexp_extract(text, pattern, 1)
        return F.coalesce(F.try_element_at(_map_literal(mapping), hit), F.lit(unknown))
    m = _map_literal(mapping) if isinstance(mapping, dict) else _col(mapping)
    words = F.transform(F.split(text, WS_RUN), lambda w: F.regexp_replace(w, TOKEN_EDGE, ""))
    hits = F.filter(F.transform(words, lambda w: F.try_element_at(m, w)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit(unknown))


def answer_to_label_by(answer, key, mappings: dict, unknown: str = UNKNOWN) -> Column:
    """TXT-5 where the mapping depends on a key column (e.g. prompt type):
    one CASE branch per configured key, each with its own literal mapping."""
    k = _col(key)
    expr = None
    for name, mapping in mappings.items():
        branch = answer_to_label(answer, mapping or {}, unknown) if mapping else F.lit(unknown)
        expr = (F.when(k == F.lit(name), branch) if expr is None
                else expr.when(k == F.lit(name), branch))
    if expr is None:
        return F.lit(unknown)
    return expr.otherwise(F.raise_error(F.concat(F.lit("no label mapping for "),
                                                 F.coalesce(k.cast("string"), F.lit("NULL")))))


def first_line(answer) -> Column:
    """``splitlines()[0]``; NULL for the empty string (which has no lines)."""
    a = _col(answer)
    return F.when(a == F.lit(""), F.lit(None).cast("string"))\
        .otherwise(F.get(F.split(a, LINE_BREAK, 2), 0))


def clean_paraphrase(answer) -> Column:
    """TXT-6: clean a generated paraphrase."""
    line = first_line(answer)
    no_numbers = F.regexp_replace(line, NUMBERING, "")
    before_stop = F.substring_index(no_numbers, ".", 1)
    return F.regexp_replace(before_stop, EDGE_WS, "")
