"""End-to-end evaluation plan (the reference's evaluation scripts as one job).

distinct (premise, hypothesis) --> generator's task (mapInPandas): every run's
prompt rendered and asked --> one row per pair: its answers in the runs' order
pairs LEFT JOIN those --explode(runs)--> raw answer --TXT-5--> prediction
      --AGG-2--> accuracy per (dataset, language, model, prompt type)
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.answers import answer_to_label_by
from ..operators.answer_store import AnswerStore, digest_of, pack_answers, prompt_digest, unpack_answers
from ..operators.generate import answer_requests, answer_runs
from ..functions.prompts import chat_prompt
from ..operators.grid import allowed_for, excluded_datasets, expand_runs, grid_prompt, grid_texts, prefix_for, run_specs
from ..operators.metrics import accuracy


def label_mappings(config: EvalConfig, task: str, prompt_types: list[str]) -> dict:
    return {t: config.prompt(task, t).label_mapping or {} for t in prompt_types}


PAIR = "_ph"
FULL = "_ph_full"
#: The store's folders that a pair's columns name; the others are those of the run.
STORE_FOLDERS = ["dataset", "text_version", "paraphrase_source"]
RUN = "_run_no"


def _short(digest):
    """The half of a pair's digest that pairs and answers are joined by (:func:`short_digest`)."""
    return F.substring(digest, 1, 16)


def _pair_digest():
    """Fixed-width key of a sentence pair; NULL where a sentence is missing."""
    return digest_of(F.concat(F.char_length("premise").cast("string"), F.lit(":"), F.col("premise"), F.col("hypothesis")))


def distinct_sentences(pairs: DataFrame) -> DataFrame:
    """The sentence pairs that are asked for ``pairs``: each once, whole ones only."""
    return pairs.select("premise", "hypothesis").dropna().dropDuplicates()


def by_digest(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the digest that answers are joined by in place of their sentences."""
    return pairs.withColumn(PAIR, _short(_pair_digest())).drop("premise", "hypothesis")


def _template_digests(spark, specs: list[tuple], prompt) -> dict[str, str]:
    """Digest of each prompt type's layout and prefix: of the prompt that it
    makes of two markers (one row per configured prompt type)."""
    types = list(dict.fromkeys(t for _, t, _ in specs))
    marks = spark.range(1).select(F.explode(F.array(*map(F.lit, types))).alias("prompt_type"),
                                  F.lit("\u0001p\u0001").alias("premise"), F.lit("\u0001h\u0001").alias("hypothesis"))
    made = marks.select("prompt_type", prompt.alias("p"))
    digest = prompt_digest(F.col("p"), made.schema["p"].dataType)
    return {r.prompt_type: r.d for r in made.select("prompt_type", F.hex(digest).alias("d")).collect()}


def _stored_answers(distinct_pairs: DataFrame, specs: list[tuple], prompt, factory: Callable, store: str,
                    batch_size: int | None, partitions: int | None, chat: bool = False) -> DataFrame:
    """Answers of each pair, in the order of ``specs``, through the store, as a
    table. A prompt is named by its template's and its pair's digest: a pair and
    its answers are one row of the store, and lookups move no sentence."""
    from ..session import materialize
    spark = distinct_pairs.sparkSession
    templates = _template_digests(spark, specs, prompt)
    # prompt types of one template send one prompt: the first asks for all of them
    first = {d: t for t, d in reversed(templates.items())}
    once = [s for s in specs if first[templates[s[1]]] == s[1]]
    place = {(m, t): i for i, (m, t, _) in enumerate(once)}
    placed = [place[m, first[templates[t]]] for m, t, _ in specs]
    runs = [(m, templates[t]) for m, t, _ in once]
    kept, by_run = AnswerStore(spark, store), None
    lists, single = kept.lists_with(runs), kept.has_single([m for m, _ in runs])
    n = n_known = 0
    if lists or single:     # pairs are read for the lookup, and again for what must be asked
        distinct_pairs = materialize(distinct_pairs, "pairs")
        n = distinct_pairs.count()
        if lists:
            by_run = kept.look_up_runs(distinct_pairs.select(PAIR), n, lists, PAIR)
        if single:
            by_run = _with_single(by_run, distinct_pairs, n, once, templates, kept)
        n_known = 0 if by_run is None else by_run.agg(F.sum(F.size("by_run"))).first()[0] or 0
    if not n_known:     # all are asked: a pair's answers stay together
        new = materialize(_ask_all(distinct_pairs.select(PAIR, "premise", "hypothesis"), [PAIR], once,
                                   prompt if chat else None, factory, batch_size, partitions), "answered")
        kept.add_runs(new, runs, PAIR, "_answers")
        in_order = F.col("_answers") if placed == list(range(len(once))) else F.array(*[F.get("_answers", F.lit(i)) for i in placed])
        return new.select(PAIR, in_order.alias("_answers"))
    if n_known < n * len(once):     # sentences are fetched for what must be asked, nothing else
        every = F.array(*[F.lit(i) for i in range(len(once))])
        lacks = F.array_except(every, F.coalesce(F.map_keys("by_run"), F.array().cast("array<int>")))
        model, kind = (F.array(*[F.lit(s[k]) for s in once]) for k in (0, 1))
        requests = (distinct_pairs.join(by_run, PAIR, "left").select(PAIR, "premise", "hypothesis", F.explode(lacks).alias(RUN))
                    .withColumn("model", F.get(model, F.col(RUN))).withColumn("prompt_type", F.get(kind, F.col(RUN))))
        new = materialize(answer_requests(requests.select(PAIR, RUN, "model", prompt.alias("_prompt")), factory, "_prompt",
                                          "model", "raw_answer", batch_size, partitions, keep=[PAIR, RUN]), "answered")
        entries = new.groupBy(PAIR).agg(F.sort_array(F.collect_list(F.struct(F.col(RUN).alias("run"), F.col("raw_answer").alias("answer")))).alias("new"))
        kept.add_runs(entries.select(PAIR, F.col("new.run").alias("places"), F.col("new.answer").alias("_answers")),
                      runs, PAIR, "_answers", "places")
        by_run = by_run.select(PAIR, "by_run").join(entries, PAIR, "full").select(PAIR, F.map_concat(*[
            F.coalesce(m, F.map_from_entries(F.array().cast("array<struct<run:int,answer:string>>")))
            for m in (F.col("by_run"), F.map_from_entries("new"))]).alias("by_run"))
    return materialize(by_run.select(PAIR, F.array(*[F.try_element_at("by_run", F.lit(i)) for i in placed]).alias("_answers")), "answers")


def _with_single(by_run: DataFrame | None, distinct_pairs: DataFrame, n: int, once: list[tuple], templates: dict,
                 kept: AnswerStore) -> DataFrame | None:
    """``by_run`` and, for the runs that it lacks, the answers that are stored
    one by one, by the digest of template and pair."""
    template = F.create_map(*[F.lit(x) for t in templates.items() for x in t])
    digest = digest_of(F.concat(template[F.col("prompt_type")], F.hex(FULL)))
    asked = expand_runs(distinct_pairs.select(PAIR, FULL), once, number_col=RUN).select(PAIR, RUN, "model", _short(digest).alias("digest"))
    found, n_found = kept.known(asked, n * len(once), "answer", list(dict.fromkeys(m for m, _, _ in once)))
    if not n_found:
        return by_run
    found = found.groupBy(PAIR).agg(F.map_from_entries(F.collect_list(F.struct(RUN, "answer"))).alias("single"))
    if by_run is None:
        return found.withColumnRenamed("single", "by_run")
    both = by_run.join(found, PAIR, "full")
    merged = F.map_concat("by_run", F.map_filter("single", lambda run, _: ~F.map_contains_key("by_run", run)))
    return both.select(PAIR, F.coalesce(merged, "by_run", "single").alias("by_run"))


def _ask_all(distinct_pairs: DataFrame, keep: list[str], specs: list[tuple], prompt, factory: Callable,
             batch_size: int | None, partitions: int | None) -> DataFrame:
    """All runs of each pair: a row per pair with the columns ``keep`` and its
    answers in the order of ``specs``. ``prompt`` is given for chat messages; a
    text prompt is made of the pair's sentences in the generator's task."""
    if prompt is None:
        return answer_runs(distinct_pairs, factory, grid_texts(specs), ["premise", "hypothesis"], "_answers",
                           batch_size, partitions, keep)
    if partitions:
        distinct_pairs = distinct_pairs.repartition(partitions)
    requests = expand_runs(distinct_pairs, specs).select(*keep, "model", prompt.alias("_prompt"))
    return answer_requests(requests, factory, "_prompt", "model", "_answers", batch_size, keep=keep, pack=len(specs))


def _answer_runs(pairs: DataFrame, factory: Callable, config: EvalConfig, task: str,
                 specs: list[tuple], types: list[str], store: str | None, checkpoint: bool,
                 chat: bool, observe: bool = False, unknown: str = "error",
                 batch_size: int | None = None, partitions: int | None = None,
                 sentences: DataFrame | None = None):
    """Answers for every (pair, run).

    * distinct requests = distinct sentence pairs x the constant run list:
      the pairs are deduplicated first, then asked on the reduce side;
    * a pair goes to its generator's task once, without prefixes: its prompts
      are rendered there, a run of a batch at a time;
    * from there on a pair is its digest: it comes back as one row, digest and
      answers (one for each configured run, in their order), so nothing is
      shuffled to group them;
    * the *unexpanded* pairs are joined to that row and expanded over the
      runs after the join, so the big side of the shuffle carries one row
      per pair, not one per (pair, run);
    * with ``checkpoint`` the answers are written once: a recomputed
      task never asks the generator again, and both inputs of the join are
      plain exchanges, so AQE can split a pair that many rows share.
    """
    allowed = pairs.filter(allowed_for(F.col("dataset"), config, task, unknown))      # CHK-3
    asked = distinct_sentences(allowed) if sentences is None else sentences
    distinct_pairs = asked.withColumn(FULL, _pair_digest()).withColumn(PAIR, _short(F.col(FULL)))
    pt = F.col("prompt_type")
    if chat:   # TXT-3: the generator receives [{role, content}, ...] per request
        prompt = chat_prompt(pt, prefix_for(pt, specs), "premise", "hypothesis")
    else:
        prompt = grid_prompt(specs)
    if store is not None:
        by_pair = _stored_answers(distinct_pairs, specs, prompt, factory, store, batch_size, partitions, chat)
    else:
        by_pair = _ask_all(distinct_pairs, [PAIR], specs, prompt if chat else None, factory, batch_size, partitions)
        if checkpoint:
            from ..session import materialize
            by_pair = materialize(by_pair, "answers")
    rows = allowed
    n_in = None
    if observe:
        from ..operators.checks import observed_count
        rows, n_in = observed_count(rows, "pairs_in")
    keyed = rows if PAIR in rows.columns else rows.withColumn(PAIR, _short(_pair_digest()))
    by_pair = by_pair.select(PAIR, pack_answers(F.col("_answers")).alias("_answers"))
    joined = keyed.join(by_pair, PAIR, "left").drop(PAIR)

    def expanded(joined: DataFrame) -> DataFrame:
        joined = joined.withColumn("_answers", unpack_answers(F.col("_answers")))
        return (expand_runs(joined, specs, number_col=RUN).withColumn("raw_answer", F.get("_answers", F.col(RUN)))
                .drop("_answers", RUN)
                .withColumn("prediction", answer_to_label_by(
                    "raw_answer", "prompt_type", label_mappings(config, task, types))))
    if not observe:
        return expanded(joined)
    # for the store: pairs lie together by their folder before there are several rows of each
    folders = [c for c in STORE_FOLDERS if c in joined.columns]
    return expanded(joined), expanded(joined.hint("rebalance", *folders) if folders else joined), n_in


def predictions(pairs: DataFrame, factory: Callable, config: EvalConfig, models: list[str],
                task: str = "binary", prompt_types: list[str] | None = None,
                store: str | None = None, checkpoint: bool = True,
                chat: bool = False, unknown: str = "error", batch_size: int | None = None,
                partitions: int | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """One row per (pair, model, prompt type): raw answer and prediction.
    A request is (model, prompt type, premise, hypothesis); its prompt is
    rendered only once per distinct request. ``checkpoint`` runs the generator
    now and stores its answers; without it the plan stays lazy, and a lost
    task asks again. ``unknown``: see :func:`allowed_for`. ``sentences``: what
    :func:`distinct_sentences` gives for ``pairs`` (those of allowed datasets),
    where the caller asks several times or can build it with less; ``pairs`` may
    then be those of :func:`by_digest`."""
    types = prompt_types or config.prompt_types(task)
    specs = run_specs(config, task, models, types)
    return _answer_runs(pairs, factory, config, task, specs, types, store, checkpoint, chat,
                        unknown=unknown, batch_size=batch_size, partitions=partitions, sentences=sentences)


def evaluate(pairs: DataFrame, factory: Callable, config: EvalConfig, models: list[str],
             by: list[str] = ("dataset", "language"), task: str = "binary",
             prompt_types: list[str] | None = None) -> DataFrame:
    """Accuracy of every run, grouped by ``by`` plus the run columns."""
    pr = predictions(pairs, factory, config, models, task, prompt_types)
    return accuracy(pr, [*by, "model", "prompt_type"])


def run_evaluation(pairs: DataFrame, factory: Callable, config: EvalConfig, models: list[str],
                   out_path: str, task: str = "binary", prompt_types: list[str] | None = None,
                   run_id: str | None = None, store: str | None = None, chat: bool = False,
                   max_missing: int = 0, skip_excluded: bool = False, unknown: str = "error",
                   batch_size: int | None = None, partitions: int | None = None,
                   by: list[str] = ("dataset", "language", "text_version", "paraphrase_source")) -> DataFrame:
    """The evaluation job: row conservation and missing answers checked on the
    stored answers before any prediction is written (CHK-2: one answered
    prediction per pair and run), then predictions written once to the
    partitioned store (SNK-2/4), as many as were checked, and published under
    a run id that the store doesn't hold yet; accuracy computed
    from the stored predictions (AGG-2) with partition pruning on run_id.

    Pairs of a dataset that doesn't list the task fail the job with their
    counts (CHK-3), unless ``skip_excluded``; so do unknown datasets, unless
    ``unknown="keep"``."""
    from ..operators.checks import check_conservation, observed_count
    from ..sources.sinks import commit_run, read_predictions, run_exists, stage_predictions, unique_run

    types = prompt_types or config.prompt_types(task)
    specs = run_specs(config, task, models, types)
    run_id = run_id or unique_run()
    if run_exists(pairs.sparkSession, out_path, run_id):
        raise ValueError(f"run {run_id!r} is already stored in {out_path}")
    if not skip_excluded and any(task not in d.prompts for d in config.datasets.values()):
        # one row per configured dataset at most
        barred = {r["dataset"]: r["n_excluded"] for r in excluded_datasets(pairs, config, task).collect()}
        if barred:
            raise ValueError(f"task {task!r} is not allowed for datasets (rows): {barred}")
    pred, placed, n_pairs = _answer_runs(pairs, factory, config, task, specs, types, store, True, chat,
                                         True, unknown, batch_size, partitions)
    # answers are stored by now: counting reads them and the pairs' digests, and asks nothing again
    asked = F.col("premise").isNotNull() & F.col("hypothesis").isNotNull()
    n_pred, missing = pred.agg(F.count(F.lit(1)), F.count_if(asked & F.col("raw_answer").isNull())).first()
    check_conservation(n_pairs.get["n_rows"] * len(specs), n_pred, "predictions per pair and run")
    if missing > max_missing:
        raise ValueError(f"{missing} of {n_pred} predictions have no answer (allowed: {max_missing})")
    attempt, n_staged = stage_predictions(placed, out_path, run_id, clustered=True)
    check_conservation(n_pred, n_staged, "predictions staged")
    commit_run(pairs.sparkSession, out_path, run_id, attempt, n_staged)
    stored = read_predictions(pred.sparkSession, out_path, run_id, pred.schema)
    keys = [c for c in by if c in stored.columns]
    return accuracy(stored, [*keys, "model", "prompt_type"])
