"""Quality rules as a bitmask ledger (operator 10).

Every rule is evaluated once per document. The ledger holds one row per
document: its measurements and a 64-bit mask whose bit i says that rule i
failed. Policies -- named, versioned sets of rules -- are applied to the
stored ledger by bit operations, so a new policy or an ablation never reads
a text again.

Nulls and empty texts measure as zero (and so fail ``few_words``); a null
``doc_id`` keeps its row; repeated rows keep one ledger row each; an empty
table gives an empty ledger; other columns of the input are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, binary_list, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_letters", "n_marks"]

_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


def measure_text(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of :data:`MEASURES`."""
    if not text:
        return (0,) * len(MEASURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(count[~_CONT & ~_WS].sum())
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    ws = text.split()
    return (len(ws), chars, int(count[_SYM].sum()), lines, dup, repeated_words(ws),
            upper, upper + lower, int(count[33] + count[63]))


def repeated_words(ws: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice (every occurrence counts)."""
    if len(ws) < 4:
        return 0
    win = window_hashes(word_hashes(ws), 3)
    order = np.argsort(win, kind="stable")
    s = win[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(win), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ws), bool)
    for i in range(3):
        covered[i:len(win) + i] |= hit
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements."""
    name: str
    bit: int
    failed: str


#: The ledger's rules. A bit is never given to another rule; a changed rule gets a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", 4, "n_letters >= 20 AND 100 * n_upper > 50 * n_letters"),
    Rule("marks", 5, "10 * n_marks > 3 * n_words"),
    Rule("long_words", 6, "word_chars > 25 * n_words"),
    Rule("short_words", 7, "n_words >= 20 AND word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules=RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
WEB = Policy("web", 1, tuple(r.name for r in RULES))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements per document (one pass, no shuffle)."""
    def fn(cols):
        got = np.array([measure_text(t) for t in binary_list(cols["_text"])], np.int64)
        got = got.reshape(len(cols["_text"]), len(MEASURES))
        return {id_col: cols[id_col]} | {m: got[:, i] for i, m in enumerate(MEASURES)}

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    return arrow_map(src, fn, f"`{id_col}` {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measurements plus ``failed``, the mask of failed rules."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for r in rules]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(df, id_col, text_col).withColumn("failed", mask)


def passes(policy: Policy, rules=RULES, failed: str = "failed") -> Column:
    """Whether the policy keeps a ledger row."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def ablation(led: DataFrame, policy: Policy, rules=RULES) -> DataFrame:
    """For every rule of the policy: documents that fail it, that fail it
    alone, and that would be kept without it. Counts are taken per distinct
    mask first (at most 2^rules rows), so no rule reads the ledger again."""
    pm = policy.mask(rules)
    by_mask = (led.select(F.col("failed").bitwiseAND(F.lit(pm).cast("bigint")).alias("m"))
               .groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    used = [r for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"),
                                        F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in used]))
    rest = F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (by_mask.select("m", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without")))


def profile(led: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bitwise aggregates of the masks: rules that failed anywhere, everywhere, and the mean number per row."""
    return led.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_or("failed").alias("any_failed"),
        F.bit_and("failed").alias("all_failed"), F.sum(F.bit_count("failed")).alias("n_failures"))
