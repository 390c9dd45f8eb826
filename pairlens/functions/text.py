"""Text column expressions: sentence split, tokens, length and overlap.

All functions map Columns to Columns and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of white space (str.split / str.strip): Java's Unicode
# White_Space property -- ``\s`` under the (?U) flag -- plus U+001C..U+001F,
# which Python also treats as white space. Plain Java ``\s`` is ASCII only.
# The (?U) property check is about twice as fast as spelling the class out.
WS = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"
WS_RUN = UNICODE + WS + "+"
EDGE_WS = UNICODE + f"^{WS}+|{WS}+$"

# Characters trimmed around a sentence piece.
SENTENCE_EDGE = " \t\r\n"
SENTENCE_STOP = r"\."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentences(text) -> Column:
    """Non-empty pieces of ``text`` split on full stops, edges trimmed."""
    pieces = F.split(_col(text), SENTENCE_STOP)
    trimmed = F.transform(pieces, lambda x: F.btrim(x, F.lit(SENTENCE_EDGE)))
    return F.array_remove(trimmed, "")


def adjacent_pairs(sents) -> Column:
    """Array of (premise, hypothesis) structs for every neighbouring pair.

    A text with one sentence gives one pair with an empty hypothesis, a text
    with none one pair of empty strings, so every record yields a pair.
    """
    s = _col(sents)
    n = F.size(s)
    prem = F.when(n <= 1, F.array(F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(""))))\
        .otherwise(F.slice(s, 1, n - 1))
    hyp = F.when(n <= 1, F.array(F.lit(""))).otherwise(F.slice(s, 2, n - 1))
    return F.arrays_zip(prem.alias("premise"), hyp.alias("hypothesis"))


def adjacent_triples(sents) -> Column:
    """(first, second, third) structs for every window of three sentences,
    padded with empty strings for texts shorter than three."""
    s = _col(sents)
    n = F.size(s)
    m = F.greatest(n - 2, F.lit(1))

    def part(offset: int) -> Column:
        return F.transform(F.sequence(F.lit(1), m),
                           lambda i: F.coalesce(F.try_element_at(s, i + offset), F.lit("")))
    return F.arrays_zip(part(0).alias("first"), part(1).alias("second"), part(2).alias("third"))


def tokens(text) -> Column:
    """Python ``str.split()``: white-space runs, no empty tokens."""
    return F.array_remove(F.split(_col(text), WS_RUN), "")


def token_count(text) -> Column:
    """ANL-1: sentence length in tokens (bigint)."""
    return F.size(tokens(text)).cast("bigint")


def token_set(text) -> Column:
    return F.array_distinct(tokens(F.lower(_col(text))))


def jaccard_of_sets(sa, sb) -> Column:
    """|A & B| / |A | B| for two distinct-token arrays; NULL when both are empty."""
    sa, sb = _col(sa), _col(sb)
    inter = F.size(F.array_intersect(sa, sb)).cast("double")
    union = F.size(sa).cast("double") + F.size(sb).cast("double") - inter
    return F.try_divide(inter, F.when(union > 0, union))


def jaccard(a, b) -> Column:
    """ANL-2: Jaccard overlap of the lower-cased token sets; NULL when both are empty."""
    return jaccard_of_sets(token_set(a), token_set(b))
