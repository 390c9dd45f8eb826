"""GEN-1 batch generation with reuse of equal requests, GEN-4 paraphrase
substitution and ALN-1 alignment of answers to pairs by key.

The generator is the caller's: a *factory* ``factory(model) -> fn`` where
``fn(prompts: pandas.Series) -> sequence of str`` answers one Arrow batch.
The factory runs once per task and model, so a client or model is loaded
once per partition, not per row.

Plan of :func:`generate`::

    rows --(request keys)--> partial dedupe (map side) --shuffle-->
    distinct requests --render prompt--> mapInPandas(generator) --> answers
    rows LEFT JOIN answers ON digest of the request keys

Equal requests collapse map-side before the shuffle, so a request repeated
in a third of all rows costs one call and one small shuffle record per task.
Requests are deduplicated by their key values; the join back is keyed by 128
bits of the texts' sha256, so that answers come back without the request's
texts. AQE's skew-join split handles a hot request on the rows side.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import side_sentence
from .answer_store import AnswerStore, answer_stored, folder_of, prompt_digest, short_digest

REQ = "_req"
PROMPT = "_prompt_digest"


def _caller(factory: Callable) -> Callable:
    """``call(model, prompts)``: each model's callable is loaded once per task."""
    loaded: dict = {}

    def call(model, prompts: pd.Series) -> list:
        fn = loaded.get(model)
        if fn is None:
            fn = loaded[model] = factory(model)
        got = list(fn(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"generator returned {len(got)} answers for {len(prompts)} prompts")
        # answers are text; None (or NaN) is a missing answer
        return [None if a is None or (isinstance(a, float) and a != a) else str(a) for a in got]
    return call


def _runner(factory: Callable, model_col: str, prompt_col: str, answer_col: str,
            out_cols: list[str], batch_size: int | None = None):
    """Per-partition loop of the generator hook: load each model's callable
    once per task, feed it positional slices of each Arrow batch."""
    def run(batches):
        import numpy as np
        call = _caller(factory)
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            answers = np.empty(n, dtype=object)
            models = pdf[model_col]
            prompts = pdf[prompt_col]
            groups = ([(models.iat[0], np.arange(n))] if models.nunique(dropna=False) == 1 else
                      [(m, np.flatnonzero((models == m).to_numpy() if not pd.isna(m)
                                          else models.isna().to_numpy()))
                       for m in models.unique()])
            for model, pos in groups:
                key = None if pd.isna(model) else model
                step = batch_size or len(pos)
                for lo in range(0, len(pos), step):
                    part = pos[lo:lo + step]
                    answers[part] = call(key, prompts.iloc[part].reset_index(drop=True))
            out = pdf[[c for c in out_cols if c != answer_col]]
            yield out.assign(**{answer_col: answers})[out_cols]
    return run


def _packed(run: Callable, n: int, answer_col: str) -> Callable:
    """``run`` over requests that come in groups of ``n`` rows behind each
    other, with equal values in all columns but the answer: one row a group,
    its answers as a list."""
    def packed(batches):
        held = None
        for pdf in run(batches):
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            whole = len(pdf) // n * n
            held = pdf.iloc[whole:] if whole < len(pdf) else None
            if whole:
                rows = pdf.iloc[:whole]
                first, last = rows.iloc[::n].reset_index(drop=True), rows.iloc[n - 1::n].reset_index(drop=True)
                if not first.drop(columns=answer_col).equals(last.drop(columns=answer_col)):
                    raise ValueError("the requests of a group don't lie behind each other")
                yield first.assign(**{answer_col: list(rows[answer_col].to_numpy().reshape(-1, n))})
        if held is not None:
            raise ValueError("a group of requests lacks some")
    return packed


def _text_keys(df: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if df.schema[k].dataType == T.StringType()]


def _with_request(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the digest of their text keys (NULL if one is missing), and
    the columns that name a request: the digest and the other keys."""
    texts = _text_keys(df, keys)
    if not texts:
        return df, list(keys)
    parts = [x for k in texts for x in (F.char_length(k).cast("string"), F.lit(":"), F.col(k))]
    return df.withColumn(REQ, short_digest(F.concat(*parts))), [REQ, *[k for k in keys if k not in texts]]


def requests_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct generation requests of ``df`` (key columns). The dedupe is a
    hash aggregate, partial on the map side, so repeated requests shrink
    before the shuffle."""
    return df.select(*keys).dropDuplicates(keys)


def answer_requests(requests: DataFrame, factory: Callable, prompt_col: str = "prompt",
                    model_col: str = "model", answer_col: str = "raw_answer",
                    batch_size: int | None = None, partitions: int | None = None,
                    keep: list[str] | None = None, pack: int | None = None) -> DataFrame:
    """Run the generator over a table of requests, one Arrow batch at a time.

    ``batch_size``: prompts per generator call (Arrow batches are cut to it;
    their size is ``spark.sql.execution.arrow.maxRecordsPerBatch``).
    ``partitions``: spread requests over this many generator tasks. AQE
    coalesces shuffle partitions by *bytes*, and requests are small, so an
    expensive generator should say how parallel it wants to run.
    ``keep``: the columns that come back with the answer (default: all).
    ``pack``: every so many rows, one behind the other, are one group with
    equal ``keep`` columns; it comes back as one row, its answers an array in
    the rows' order. (Such requests are dealt out before they are expanded.)"""
    if partitions:
        if pack:
            raise ValueError("groups of requests must be dealt out before they are expanded")
        requests = requests.repartition(partitions)
    fields = [f for f in requests.schema.fields if keep is None or f.name in keep]
    out_cols = [f.name for f in fields] + [answer_col]
    kind = T.ArrayType(T.StringType()) if pack else T.StringType()
    schema = T.StructType(fields + [T.StructField(answer_col, kind, True)])
    run = _runner(factory, model_col, prompt_col, answer_col, out_cols, batch_size)
    return requests.mapInPandas(_packed(run, pack, answer_col) if pack else run, schema)


def answer_runs(rows: DataFrame, factory: Callable, runs: list[tuple], inputs: list[str],
                answer_col: str = "raw_answer", batch_size: int | None = None,
                partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Run the generator over every run of each row: ``runs`` lists ``(model,
    render)``, and ``render`` makes a batch's prompts from its ``inputs``.

    A row goes to its generator task once, as its short inputs; the prompts
    -- mostly a run's long constant prefix -- are made there, of one batch and
    run at a time. Back come the columns ``keep`` (default: all) and the row's
    answers, an array in the order of ``runs``. The other options are those of
    :func:`answer_requests`."""
    if partitions:
        rows = rows.repartition(partitions)
    kept = [f for f in rows.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in kept]

    def run(batches):
        import numpy as np
        call = _caller(factory)
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            answers = np.empty((n, len(runs)), dtype=object)
            step = batch_size or n
            for lo in range(0, n, step):
                part = [pdf[c].iloc[lo:lo + step].tolist() for c in inputs]
                for i, (model, render) in enumerate(runs):
                    answers[lo:lo + step, i] = call(model, pd.Series(render(*part)))
            yield pdf[names].assign(**{answer_col: list(answers)})
    schema = T.StructType(kept + [T.StructField(answer_col, T.ArrayType(T.StringType()), True)])
    columns = list(dict.fromkeys([*names, *inputs]))
    return rows.select(*columns).mapInPandas(run, schema)


def generate(df: DataFrame, factory: Callable, prompt: Column | str = "prompt",
             keys: list[str] | None = None, model_col: str = "model",
             answer_col: str = "raw_answer", store: str | None = None,
             checkpoint: bool = False, batch_size: int | None = None,
             partitions: int | None = None, requests: DataFrame | None = None) -> DataFrame:
    """GEN-1: add ``answer_col`` to every row, calling the generator once per
    distinct request.

    A request is identified by ``keys`` (default: the model and prompt
    columns). With ``keys`` naming the prompt's *inputs* (e.g. model, prompt
    type, premise, hypothesis) and ``prompt`` a Column rendering it from
    them, only the short inputs travel through the shuffles; the prompt --
    mostly a long constant prefix -- is rendered for distinct requests only.

    Rows whose prompt is NULL (missing text) are kept with a NULL answer;
    the generator never sees them.

    ``df`` is read twice (rows, and distinct requests); it must be
    deterministic -- store the output of an earlier generation step (e.g.
    paraphrases) before evaluating it.

    ``requests``: the distinct key combinations, when the caller can build
    them more cheaply than deduplicating ``df`` (e.g. distinct sentence
    pairs expanded over a constant run list).

    ``store``: a shared folder of answers by model and digest of the prompt
    as sent (:mod:`.answer_store`), so another prefix or layout is another
    request. Requests answered there are not asked again, new answers are
    appended, and only the current requests' answers are read back (the
    earliest, where two runs stored one each).
    ``checkpoint``: without a store, write the answers once as Parquet into
    the session's shared checkpoint folder and read them back, so
    recomputing a later stage never re-runs the generator.
    """
    if keys is None:
        if not isinstance(prompt, str):
            raise ValueError("a prompt expression needs the request keys it is rendered from")
        keys = [model_col, prompt]
    if store is not None:
        return _generate_stored(df, factory, prompt, model_col, answer_col, store, batch_size, partitions)
    rows, request = _with_request(df, keys)
    requests = requests_of(df, keys) if requests is None else requests.select(*keys)
    answers = answer_distinct(requests, factory, prompt, keys, model_col, answer_col,
                              checkpoint, batch_size, partitions)
    return rows.join(answers, request, "left").select(*keys, *[c for c in df.columns if c not in keys], answer_col)


def _generate_stored(df: DataFrame, factory: Callable, prompt: Column | str, model_col: str, answer_col: str,
                     store: str, batch_size: int | None, partitions: int | None) -> DataFrame:
    """Rows joined to the store's answers by model and prompt digest."""
    prompt_expr = F.col(prompt) if isinstance(prompt, str) else prompt
    model = F.col(model_col) if model_col in df.columns else F.lit(None).cast("string")
    kind = df.select(prompt_expr.alias("p")).schema["p"].dataType
    digest = prompt_digest(prompt_expr, kind)
    asked = df.select(model.alias("model"), digest.alias("digest")).filter("digest IS NOT NULL").distinct()

    def ask(missing: DataFrame | None) -> DataFrame:
        texts = df.select(model.alias("model"), digest.alias("digest"), prompt_expr.alias("_prompt")).filter("digest IS NOT NULL")
        if missing is not None:
            m = missing.withColumn("model", folder_of(F.col("model")))
            texts = texts.withColumn("_f", folder_of(F.col("model"))).join(
                m.withColumnRenamed("model", "_f"), ["_f", "digest"], "left_semi").drop("_f")
        return answer_requests(texts.dropDuplicates(["model", "digest"]), factory, "_prompt", "model", answer_col,
                               batch_size, partitions)

    found = answer_stored(asked, AnswerStore(df.sparkSession, store), ask, answer_col)
    found = found.select(folder_of(F.col("model")).alias("_folder"), F.col("digest").alias(PROMPT), answer_col)
    rows = df.withColumn("_folder", folder_of(model)).withColumn(PROMPT, digest)
    return rows.join(found, ["_folder", PROMPT], "left").drop("_folder", PROMPT)


def answer_distinct(requests: DataFrame, factory: Callable, prompt: Column | str,
                    keys: list[str], model_col: str = "model", answer_col: str = "raw_answer",
                    checkpoint: bool = False, batch_size: int | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Answer a table of *distinct* requests (key columns): render each prompt,
    skip NULL prompts, call the generator. Returns the columns that name a
    request (the digest of its texts, and its other keys) and the answer."""
    requests, request = _with_request(requests.select(*keys), keys)
    prompt_expr = F.col(prompt) if isinstance(prompt, str) else prompt
    model = F.col(model_col) if model_col in keys else F.lit(None).cast("string")
    rendered = (requests.withColumn("_prompt", prompt_expr)
                .filter(F.col("_prompt").isNotNull())
                .select(*request, model.alias("_model"), "_prompt"))
    answers = answer_requests(rendered, factory, "_prompt", "_model", answer_col, batch_size, partitions, keep=request)
    if checkpoint:
        from ..session import materialize
        answers = materialize(answers, "answers")
    return answers


def substitute_paraphrase(df: DataFrame, side, paraphrase_col: str = "paraphrase",
                          premise_col: str = "premise", hypothesis_col: str = "hypothesis") -> DataFrame:
    """GEN-4 (+ PRJ-3): write the paraphrase in place of the chosen side and
    keep the replaced text as ``original_sentence`` with ``changed_side``.
    ``side`` is ``'p'``, ``'h'`` or a column holding them per row."""
    s = F.lit(side) if isinstance(side, str) else side
    original = side_sentence(s, premise_col, hypothesis_col)
    return (df.withColumn("original_sentence", original)
              .withColumn("changed_side", s)
              .withColumn(premise_col, F.when(s == F.lit("p"), F.col(paraphrase_col))
                          .otherwise(F.col(premise_col)))
              .withColumn(hypothesis_col, F.when(s == F.lit("h"), F.col(paraphrase_col))
                          .otherwise(F.col(hypothesis_col)))
              .drop(paraphrase_col))

