"""DuckDB twins of the Spark plans (the correctness oracle).

These strings are only used to check results; Spark never runs them.
"""

from __future__ import annotations

from ..config import EXPERT_PROMPT
from .fixtures import STUB_ANSWERS


# Python's white space spelled out for RE2 (no Unicode flag there); the same
# set as the Java-side (?U)[\s\x1c-\x1f].
WS_CLASS = (r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TRIM_CHARS = "' ' || chr(9) || chr(13) || chr(10)"

LABELLED = """
labelled AS (
  SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic,
         list_filter(list_transform(string_split(d.text, '.'),
                                    lambda x: trim(x, {trim})),
                     lambda x: x <> '') AS s
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""".format(trim=TRIM_CHARS)

_PAIRS = """,
pairs AS (
  SELECT source AS dataset, doc_id AS pair_id, CAST(i - 1 AS BIGINT) AS pair_no,
         lang AS language, coalesce(s[i], '') AS premise, coalesce(s[i + 1], '') AS hypothesis,
         CASE WHEN quality = 1 THEN 'entailment' WHEN quality IS NOT NULL THEN 'not_entailment' END AS gold_label,
         quality, toxic
  FROM (SELECT *, unnest(range(1, greatest(len(s), 2))) AS i FROM labelled))"""

PAIRS = LABELLED + _PAIRS
#: Every document, labelled or not, and its pairs.
ALL_DOCUMENTS = LABELLED.replace("documents d JOIN", "documents d LEFT JOIN")
ALL_PAIRS = ALL_DOCUMENTS + _PAIRS


def values(rows: list[tuple], names: list[str]) -> str:
    body = ",\n    ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")"
                           for r in rows)
    return f"(VALUES\n    {body}) AS v({', '.join(names)})"


def pair_prompt(prompt_type: str, prefix: str, p: str = "premise", h: str = "hypothesis") -> str:
    nl = "chr(10)"
    expert = f"{prefix} || {nl} || ' Premise: ' || {p} || {nl} || ' Hypothesis: ' || {h} || {nl} || ' Answer: '"
    plain = f"{prefix} || ' ' || {p} || ' -> ' || {h} || ': '"
    return f"CASE WHEN {prompt_type} = {lit(EXPERT_PROMPT)} THEN {expert} ELSE {plain} END"


def stub_answer(prompt: str) -> str:
    n = len(STUB_ANSWERS)
    whens = " ".join(f"WHEN {i} THEN {lit(a)}" for i, a in enumerate(STUB_ANSWERS))
    return f"(CASE length({prompt}) % {n} {whens} END)"


def answer_tokens(answer: str) -> str:
    return (f"list_transform(regexp_split_to_array(lower({answer}), '{WS_CLASS}+'), "
            f"lambda w: regexp_replace(w, '^[.,]+|[.,]+$', '', 'g'))")


def answer_label(answer: str, key: str, mappings: dict) -> str:
    """TXT-5 in DuckDB: first token that is a key of the row's mapping."""
    branches = []
    for name, m in mappings.items():
        inner = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in m.items())
        branches.append(f"WHEN {key} = {lit(name)} THEN (CASE w {inner} END)")
    case = "CASE " + " ".join(branches) + " END"
    return (f"coalesce(list_filter(list_transform({answer_tokens(answer)}, lambda w: {case}), "
            f"lambda x: x IS NOT NULL)[1], 'unk')")


ACCURACY = ("count(*) AS n_total, "
            "CAST(sum(CASE WHEN gold_label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, "
            "CAST(sum(CASE WHEN gold_label = prediction THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy")


TRIPLES = """,
triples AS (
  SELECT doc_id AS rid, CAST(i - 1 AS BIGINT) AS win_no, coalesce(s[i], '') AS startphrase,
         coalesce(s[i + 1], '') AS ending1, coalesce(s[i + 2], '') AS ending2, quality AS labels
  FROM (SELECT *, unnest(range(1, greatest(len(s) - 1, 2))) AS i FROM labelled))"""


def stub_paraphrase(sentence: str) -> str:
    return (f"(CAST(length({sentence}) % 10 AS VARCHAR) || '. ' || lower({sentence}) "
            f"|| chr(10) || 'Note: literal.')")


def paraphrase_prompt(prefix_sql: str, sentence: str) -> str:
    return f"{prefix_sql} || ' Original sentence: ' || {sentence} || ' Paraphrase: '"


LINE_BREAK_RE2 = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def clean(answer: str) -> str:
    first = f"regexp_split_to_array({answer}, '{LINE_BREAK_RE2}')[1]"
    body = f"split_part(regexp_replace({first}, '[0-9]+.', '', 'g'), '.', 1)"
    return (f"(CASE WHEN {answer} = '' THEN NULL ELSE "
            f"regexp_replace({body}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g') END)")


def token_count(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda w: w <> '')) AS BIGINT)"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{WS_CLASS}+'), lambda w: w <> ''))"


def jaccard(a: str, b: str) -> str:
    sa, sb = token_set(a), token_set(b)
    inter = f"CAST(len(list_intersect({sa}, {sb})) AS DOUBLE)"
    union = f"CAST(len(list_distinct(list_concat({sa}, {sb}))) AS DOUBLE)"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} END)"
