"""Prompt rendering as column expressions (TXT-1 .. TXT-4).

Each renderer is a ``concat`` of literals and columns, so whole-stage
codegen compiles it; no Python runs per row. :func:`pair_texts` makes the same
pair prompts where a generator's task holds the sentences already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXPERT_PROMPT

#: What stands before the premise, between the sentences and behind the hypothesis.
PLAIN = (" ", " -> ", ": ")
EXPERT = ("\n Premise: ", "\n Hypothesis: ", "\n Answer: ")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _laid_out(layout: tuple, prefix, premise, hypothesis) -> Column:
    before, between, behind = map(F.lit, layout)
    return F.concat(_lit(prefix), before, _col(premise), between, _col(hypothesis), behind)


def plain_prompt(prefix, premise, hypothesis) -> Column:
    """TXT-1: ``prefix + " {p} -> {h}: "``."""
    return _laid_out(PLAIN, prefix, premise, hypothesis)


def expert_prompt(prefix, premise, hypothesis) -> Column:
    """TXT-2: ``prefix + "\\n Premise: {p}\\n Hypothesis: {h}\\n Answer: "``."""
    return _laid_out(EXPERT, prefix, premise, hypothesis)


def pair_prompt(prompt_type, prefix, premise, hypothesis) -> Column:
    """Plain or expert layout chosen by prompt type (a literal or a column)."""
    if isinstance(prompt_type, str):
        if prompt_type == EXPERT_PROMPT:
            return expert_prompt(prefix, premise, hypothesis)
        return plain_prompt(prefix, premise, hypothesis)
    return F.when(prompt_type == F.lit(EXPERT_PROMPT), expert_prompt(prefix, premise, hypothesis))\
        .otherwise(plain_prompt(prefix, premise, hypothesis))


def pair_texts(prompt_type: str, prefix: str | None, premises, hypotheses) -> list:
    """The prompts of :func:`pair_prompt` for sentences at hand; None where the
    prefix or a sentence is missing."""
    before, between, behind = EXPERT if prompt_type == EXPERT_PROMPT else PLAIN
    if prefix is None:
        return [None] * len(premises)
    head = prefix + before
    return [None if p is None or h is None else f"{head}{p}{between}{h}{behind}" for p, h in zip(premises, hypotheses)]


def chat_user_text(prompt_type, premise, hypothesis) -> Column:
    """User turn of TXT-3. The expert body differs from TXT-2: no leading
    newline-space and no trailing space."""
    expert = F.concat(F.lit("Premise: "), _col(premise), F.lit("\n Hypothesis: "),
                      _col(hypothesis), F.lit("\n Answer:"))
    plain = F.concat(F.lit(" "), _col(premise), F.lit(" -> "), _col(hypothesis), F.lit(": "))
    if isinstance(prompt_type, str):
        return expert if prompt_type == EXPERT_PROMPT else plain
    return F.when(prompt_type == F.lit(EXPERT_PROMPT), expert).otherwise(plain)


def chat_prompt(prompt_type, prefix, premise, hypothesis) -> Column:
    """TXT-3: ``[{role: system, content: prefix}, {role: user, content: body}]``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), _lit(prefix).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 chat_user_text(prompt_type, premise, hypothesis).alias("content")),
    )


def paraphrase_prompt(prefix, sentence) -> Column:
    """TXT-4: ``prefix + " Original sentence: {s} Paraphrase: "``."""
    return F.concat(_lit(prefix), F.lit(" Original sentence: "), _col(sentence),
                    F.lit(" Paraphrase: "))


def side_sentence(side, premise, hypothesis) -> Column:
    """The sentence a paraphrase request is about: premise for side ``p``,
    hypothesis for ``h``; anything else is an error in the plan."""
    s = _col(side) if not isinstance(side, str) or side not in ("p", "h") else F.lit(side)
    return F.when(s == F.lit("p"), _col(premise))\
        .when(s == F.lit("h"), _col(hypothesis))\
        .otherwise(F.raise_error(F.concat(F.lit("side must be 'p' or 'h', got "),
                                          F.coalesce(s.cast("string"), F.lit("NULL")))))
