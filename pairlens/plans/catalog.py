"""Registered queries: Spark plans over the driver's tables and their DuckDB twins.

Every query reads the given tables (or data Spark derives from them) whole.
The generator is a deterministic stand-in (``fixtures.stub_factory``) whose
answers the SQL twin can recompute.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DatasetSpec, EvalConfig
from ..functions.answers import answer_to_label, clean_paraphrase
from ..functions.prompts import chat_prompt, pair_prompt, paraphrase_prompt, side_sentence
from ..operators import analysis as A
from ..operators import checks as C
from ..operators import prepare as PR
from ..operators.grid import allowed_for, excluded_datasets, expand_runs, prefix_for, render_grid, run_specs
from ..operators.metrics import accuracy, distinct_labels
from ..operators.runs import reuse_consecutive
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.class_files import read_class_files
from ..sources.config import read_config_tables, run_table
from ..session import materialize, new_shared_subdir
from . import fixtures as fx
from . import sql as S
from .evaluate import by_digest, distinct_sentences, label_mappings, predictions

TASK = "binary"
KEYS = ["dataset", "pair_id", "pair_no"]


def _cfg():
    return fx.fixture_config()


def _types():
    return _cfg().prompt_types(TASK)


def _prefix(t: str, task: str = TASK) -> str:
    return _cfg().prompt(task, t).prefix


def _runs_sql(models=(fx.STUB_MODEL,)) -> str:
    rows = [(m, t, _prefix(t)) for m in models for t in _types()]
    return S.values(rows, ["model", "prompt_type", "prefix"])


def _mappings():
    return label_mappings(_cfg(), TASK, _types())


def _para_prefix() -> str:
    return _cfg().prompt("paraphrase_gen", "instruct").prefix


def _pred(spark, sf_dir, features: bool = False, labelled: bool = True) -> DataFrame:
    pairs = fx.pairs(spark, sf_dir, labelled)
    if features:
        pairs = A.with_surface_features(pairs)
    return predictions(pairs, fx.stub_factory, _cfg(), [fx.STUB_MODEL], TASK, unknown="keep")


def _pred_sql(source: str = "pairs") -> str:
    return f"""runs AS (SELECT * FROM {_runs_sql()}),
g AS (SELECT p.*, r.model, r.prompt_type,
             {S.pair_prompt('r.prompt_type', 'r.prefix')} AS prompt
      FROM {source} p CROSS JOIN runs r),
pr AS (SELECT *, {S.stub_answer('prompt')} AS raw_answer FROM g),
pred AS (SELECT *, {S.answer_label('raw_answer', 'prompt_type', _mappings())} AS prediction FROM pr)"""


# ---------------------------------------------------------------- evaluation
def accuracy_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1/2, GRD-1, GEN-1, TXT-5, ALN-1, AGG-1/2."""
    return accuracy(_pred(spark, sf_dir), ["dataset", "language", "model", "prompt_type"])


def accuracy_by_dataset_sql() -> str:
    return f"""WITH {S.PAIRS}, {_pred_sql()}
SELECT dataset, language, model, prompt_type, {S.ACCURACY}
FROM pred GROUP BY dataset, language, model, prompt_type"""


def generate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-1: one generator call per distinct (model, prompt), joined back."""
    return _pred(spark, sf_dir, labelled=False).select(*KEYS, "prompt_type", "raw_answer")


def generate_dedup_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}, {_pred_sql()}
SELECT dataset, pair_id, pair_no, prompt_type, raw_answer FROM pred"""


# ------------------------------------------------------------ answer parsing
def answer_to_label_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-5 over whole documents used as answers."""
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", answer_to_label("text", fx.WORD_MAPPING).alias("prediction"))


def answer_to_label_sql() -> str:
    m = {"w": fx.WORD_MAPPING}
    return f"""SELECT doc_id, {S.answer_label('text', "'w'", m)} AS prediction FROM documents"""


def clean_paraphrase_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-6 over whole documents behind a numbered prefix."""
    docs = fx.table(spark, sf_dir, "documents")
    raw = F.concat((F.col("doc_id") % 10).cast("string"), F.lit(". "), F.col("text"))
    return docs.select("doc_id", clean_paraphrase(raw).alias("clean"))


def clean_paraphrase_sql() -> str:
    return f"""SELECT doc_id, {S.clean('raw')} AS clean
FROM (SELECT doc_id, CAST(doc_id % 10 AS VARCHAR) || '. ' || text AS raw FROM documents)"""


# --------------------------------------------------------------- preparation
def choice_to_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE-1 (+ CHK-1 on the choice label)."""
    return PR.choice_to_pairs(fx.choice_rows(spark, sf_dir), keep=["rid", "win_no"])


def choice_to_pairs_sql() -> str:
    return f"""WITH {S.LABELLED}{S.TRIPLES}
SELECT rid, win_no, CAST(0 AS BIGINT) AS choice_no, startphrase AS premise,
       CASE WHEN labels = 0 THEN ending1 ELSE ending2 END AS hypothesis, 'entailment' AS label
FROM triples
UNION ALL
SELECT rid, win_no, CAST(1 AS BIGINT), startphrase,
       CASE WHEN labels = 0 THEN ending2 ELSE ending1 END, 'not_entailment'
FROM triples"""


def union_labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE-2 + PRJ-4: class given by the file; stamp and append."""
    p = fx.pairs(spark, sf_dir)
    cols = [*KEYS, "premise", "hypothesis"]
    files = {"entailment": p.filter(F.col("gold_label") == "entailment").select(*cols),
             "not_entailment": p.filter(F.col("gold_label") == "not_entailment").select(*cols)}
    return C.assert_domain(PR.union_class_files(files), "label", PR.BINARY)


def union_labelled_files_sql() -> str:
    return f"""WITH {S.PAIRS}
SELECT dataset, pair_id, pair_no, premise, hypothesis, 'entailment' AS label
FROM pairs WHERE gold_label = 'entailment'
UNION ALL
SELECT dataset, pair_id, pair_no, premise, hypothesis, 'not_entailment' AS label
FROM pairs WHERE gold_label = 'not_entailment'"""


def collapse_two_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE-3: lower-case, check, keep original, contradiction -> not_entailment."""
    df = PR.two_label_to_binary(fx.two_label_rows(spark, sf_dir))
    return df.select(*KEYS, "label_original", "label")


def collapse_two_labels_sql() -> str:
    return f"""WITH {S.PAIRS}
SELECT dataset, pair_id, pair_no,
       CASE WHEN quality = 1 THEN 'entailment' ELSE 'contradiction' END AS label_original,
       CASE WHEN quality = 1 THEN 'entailment' ELSE 'not_entailment' END AS label
FROM pairs"""


def collapse_three_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRE-4 + FLT-2: English only, three labels -> binary."""
    df = PR.three_label_to_binary(fx.three_label_rows(spark, sf_dir), language="en")
    return df.select(*KEYS, "language", "gold_label_original", "gold_label")


def collapse_three_labels_sql() -> str:
    return f"""WITH {S.PAIRS},
t AS (SELECT *, CASE WHEN quality = 0 THEN 'contradiction' WHEN toxic = 1 THEN 'neutral'
                     ELSE 'entailment' END AS g FROM pairs)
SELECT dataset, pair_id, pair_no, language, g AS gold_label_original,
       CASE WHEN g = 'entailment' THEN 'entailment' ELSE 'not_entailment' END AS gold_label
FROM t WHERE language = 'en'"""


# ------------------------------------------------------------------- prompts
def prompt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-1 with the few-shot question prompt."""
    p = fx.pairs(spark, sf_dir, labelled=False)
    return p.select(*KEYS, pair_prompt("qa-few-ent", F.lit(_prefix("qa-few-ent")),
                                       "premise", "hypothesis").alias("prompt"))


def prompt_plain_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}
SELECT dataset, pair_id, pair_no,
       {S.pair_prompt(S.lit('qa-few-ent'), S.lit(_prefix('qa-few-ent')))} AS prompt FROM pairs"""


def prompt_expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-2: the expert (chain) layout."""
    p = fx.pairs(spark, sf_dir, labelled=False)
    return p.select(*KEYS, pair_prompt("chain", F.lit(_prefix("chain")),
                                       "premise", "hypothesis").alias("prompt"))


def prompt_expert_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}
SELECT dataset, pair_id, pair_no,
       {S.pair_prompt(S.lit('chain'), S.lit(_prefix('chain')))} AS prompt FROM pairs"""


def prompt_paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-4: paraphrase request for the premise (even ids) or hypothesis."""
    p = fx.pairs(spark, sf_dir, labelled=False).withColumn("changed_side", fx.side_of())
    sent = side_sentence(F.col("changed_side"), "premise", "hypothesis")
    return p.select(*KEYS, "changed_side", paraphrase_prompt(F.lit(_para_prefix()), sent).alias("prompt"))


def prompt_paraphrase_sql() -> str:
    return f"""WITH {S.ALL_PAIRS},
s AS (SELECT *, CASE WHEN pair_id % 2 = 0 THEN 'p' ELSE 'h' END AS changed_side FROM pairs)
SELECT dataset, pair_id, pair_no, changed_side,
       {S.paraphrase_prompt(S.lit(_para_prefix()),
                            "CASE WHEN changed_side = 'p' THEN premise ELSE hypothesis END")} AS prompt
FROM s"""


def prompt_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3 in exploded form, shaped like ``conversations``."""
    specs = [(fx.STUB_MODEL, t, _prefix(t)) for t in _types()]
    g = expand_runs(fx.pairs(spark, sf_dir, labelled=False), specs)
    msgs = chat_prompt(F.col("prompt_type"), prefix_for(F.col("prompt_type"), specs),
                       "premise", "hypothesis")
    ex = g.select("dataset", F.col("pair_id").alias("conv_id"), "pair_no", "prompt_type",
                  F.posexplode(msgs).alias("turn", "m"))
    return ex.select("dataset", "conv_id", "pair_no", "prompt_type",
                     F.col("turn").cast("bigint").alias("turn"),
                     F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def prompt_chat_sql() -> str:
    rows = [(t, _prefix(t)) for t in _types()]
    user = ("CASE WHEN prompt_type = 'chain' THEN 'Premise: ' || premise || chr(10) || "
            "' Hypothesis: ' || hypothesis || chr(10) || ' Answer:' "
            "ELSE ' ' || premise || ' -> ' || hypothesis || ': ' END")
    return f"""WITH {S.ALL_PAIRS},
g AS (SELECT p.*, r.prompt_type, r.prefix FROM pairs p CROSS JOIN (SELECT * FROM {S.values(rows, ['prompt_type', 'prefix'])}) r)
SELECT dataset, pair_id AS conv_id, pair_no, prompt_type, CAST(0 AS BIGINT) AS turn,
       'system' AS role, prefix AS text FROM g
UNION ALL
SELECT dataset, pair_id, pair_no, prompt_type, CAST(1 AS BIGINT), 'user', {user} FROM g"""


def _grid_cfg():
    """The fixture configuration with two sources named: one lists the task, one doesn't."""
    cfg = _cfg()
    for name, prompts in (("src0", [TASK]), ("src1", ["other"])):
        cfg.datasets[name] = DatasetSpec(name=name, prompts=prompts)
    return cfg


def _grid_models():
    return [m for m in _cfg().models if m != fx.STUB_MODEL]


def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-1/2 + CHK-3: every configured model x prompt type over every
    dataset that allows the task, in one job; prompt volume per run."""
    cfg = _grid_cfg()
    specs = run_specs(cfg, TASK, _grid_models())
    g = render_grid(fx.pairs(spark, sf_dir, labelled=False), specs, cfg, TASK, unknown="keep")
    return g.groupBy("dataset", "model", "prompt_type").agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum(F.length("prompt")).cast("bigint").alias("prompt_chars"))


def run_grid_sql() -> str:
    return f"""WITH {S.ALL_PAIRS},
runs AS (SELECT * FROM {_runs_sql(_grid_models())}),
g AS (SELECT p.dataset, r.model, r.prompt_type,
             {S.pair_prompt('r.prompt_type', 'r.prefix')} AS prompt
      FROM pairs p CROSS JOIN runs r WHERE p.dataset IS DISTINCT FROM 'src1')
SELECT dataset, model, prompt_type, count(*) AS n_prompts,
       CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars
FROM g GROUP BY dataset, model, prompt_type"""


def excluded_datasets_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-3 as a report: rows of the datasets that don't list the task."""
    return excluded_datasets(fx.pairs(spark, sf_dir, labelled=False), _grid_cfg(), TASK)


def excluded_datasets_sql() -> str:
    return f"""WITH {S.ALL_PAIRS} SELECT dataset, count(*) AS n_excluded
FROM pairs WHERE dataset = 'src1' GROUP BY dataset"""


# --------------------------------------------------------- reuse and rewrite
def reuse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-2: one paraphrase call per run of consecutive equal sentences."""
    docs = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_ord"), F.col("lang").alias("sentence"))
    out = reuse_consecutive(docs, fx.stub_paraphraser, ["row_ord"], "sentence",
                            paraphrase_prompt(F.lit(_para_prefix()), F.col("sentence")),
                            model=fx.STUB_MODEL, answer_col="paraphrase")
    return out.select("row_ord", "sentence", "is_new", "run_no", "paraphrase")


def reuse_runs_sql() -> str:
    return f"""WITH x AS (
  SELECT doc_id AS row_ord, lang AS sentence,
         lag(lang) OVER (ORDER BY doc_id) AS prev, row_number() OVER (ORDER BY doc_id) AS rn
  FROM documents),
y AS (SELECT *, CASE WHEN rn = 1 THEN TRUE ELSE coalesce(sentence <> prev, TRUE) END AS is_new FROM x),
z AS (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END)
                     OVER (ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no
      FROM y),
h AS (SELECT run_no, sentence AS head FROM z WHERE is_new)
SELECT z.row_ord, z.sentence, z.is_new, z.run_no, {S.stub_paraphrase('h.head')} AS paraphrase
FROM z JOIN h ON z.run_no = h.run_no"""


def reuse_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-2 over real sentences: the rows of the two-choice pairs repeat their
    premise; one call per run of equal premises, in document order. The label
    only orders the two endings, so a document without one counts as 0."""
    rows = fx.choice_rows(spark, sf_dir, labelled=False).withColumn("labels", F.coalesce("labels", F.lit(0)))
    c = PR.choice_to_pairs(rows, keep=["rid", "win_no"])
    out = reuse_consecutive(c.select("rid", "win_no", "choice_no", "premise"), fx.stub_paraphraser,
                            ["rid", "win_no", "choice_no"], "premise",
                            paraphrase_prompt(F.lit(_para_prefix()), F.col("premise")),
                            model=fx.STUB_MODEL, answer_col="paraphrase")
    return out.select("rid", "win_no", "choice_no", "is_new", "run_no", "paraphrase")


def reuse_sentences_sql() -> str:
    return f"""WITH {S.ALL_DOCUMENTS}{S.TRIPLES},
c AS (SELECT rid, win_no, CAST(n AS BIGINT) AS choice_no, startphrase AS premise
      FROM triples CROSS JOIN range(2) AS two(n)),
x AS (SELECT *, lag(premise) OVER o AS prev, row_number() OVER o AS rn
      FROM c WINDOW o AS (ORDER BY rid, win_no, choice_no)),
y AS (SELECT *, rn = 1 OR premise <> prev AS is_new FROM x),
z AS (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS BIGINT) AS run_no FROM y)
SELECT rid, win_no, choice_no, is_new, run_no, {S.stub_paraphrase('premise')} AS paraphrase FROM z"""


def reuse_runs_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-3: reuse keyed by a supplied id (the pair's record id): one call
    per record run, rendered from the run head's premise."""
    p = fx.pairs(spark, sf_dir, labelled=False).select(*KEYS, "premise")
    out = reuse_consecutive(p, fx.stub_paraphraser, ["pair_id", "pair_no"], "pair_id",
                            paraphrase_prompt(F.lit(_para_prefix()), F.col("premise")),
                            model=fx.STUB_MODEL, partition_cols=["dataset"], answer_col="paraphrase")
    return out.select(*KEYS, "is_new", "run_no", "paraphrase")


def reuse_runs_by_key_sql() -> str:
    return f"""WITH {S.ALL_PAIRS},
x AS (SELECT dataset, pair_id, pair_no, premise,
             lag(pair_id) OVER (PARTITION BY dataset ORDER BY pair_id, pair_no) AS prev,
             row_number() OVER (PARTITION BY dataset ORDER BY pair_id, pair_no) AS rn
      FROM pairs),
y AS (SELECT *, CASE WHEN rn = 1 THEN TRUE ELSE coalesce(pair_id <> prev, TRUE) END AS is_new FROM x),
z AS (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY pair_id, pair_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no FROM y),
h AS (SELECT dataset, run_no, premise AS head FROM z WHERE is_new)
SELECT z.dataset, z.pair_id, z.pair_no, z.is_new, z.run_no, {S.stub_paraphrase('h.head')} AS paraphrase
FROM z JOIN h ON z.dataset = h.dataset AND z.run_no = h.run_no"""


def _paraphrased_pairs(pairs: DataFrame) -> DataFrame:
    """Paraphrase pipeline: request -> GEN-1 -> TXT-6 clean -> GEN-4 substitute,
    premise for even record ids, hypothesis for odd ones."""
    from .paraphrase import paraphrase_pairs
    return paraphrase_pairs(pairs, fx.stub_paraphraser, fx.STUB_MODEL,
                            fx.side_of(), _cfg(), reuse="distinct", clean=True,
                            materialize=False)


def substitute_paraphrase_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-4 + PRJ-3 + TXT-4 + TXT-6 through the generator."""
    return _paraphrased_pairs(fx.pairs(spark, sf_dir, labelled=False)).select(
        *KEYS, "premise", "hypothesis", "gold_label", "original_sentence", "changed_side")


def _paraphrased_sql() -> str:
    sent = "CASE WHEN side = 'p' THEN premise ELSE hypothesis END"
    return f""",
ps AS (SELECT *, CASE WHEN pair_id % 2 = 0 THEN 'p' ELSE 'h' END AS side FROM pairs),
pc AS (SELECT *, {S.clean(S.stub_paraphrase(sent))} AS paraphrase FROM ps),
para AS (SELECT dataset, pair_id, pair_no, language,
                CASE WHEN side = 'p' THEN paraphrase ELSE premise END AS premise,
                CASE WHEN side = 'h' THEN paraphrase ELSE hypothesis END AS hypothesis,
                gold_label, quality, toxic, {sent} AS original_sentence, side AS changed_side
         FROM pc)"""


def substitute_paraphrase_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}{_paraphrased_sql()}
SELECT dataset, pair_id, pair_no, premise, hypothesis, gold_label, original_sentence, changed_side
FROM para"""


# ------------------------------------------------------------ checks, counts
def label_domain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1 as reports over the two-label, three-label and binary labels."""
    english = F.col("language") == "en"
    two = fx.two_label_rows(spark, sf_dir).withColumn("two_label", F.lower("label"))
    values = two.withColumn("three_label", F.when(english, fx.three_label()))
    # one row per check and value in one scan; a row outside a check's filter has no entry there
    entry = lambda name, value: F.struct(F.lit(name).alias("check"), value.alias("value"))
    stacked = values.select(F.explode(F.array_compact(F.array(
        entry("two_label", F.col("two_label")), F.when(english, entry("three_label", F.col("three_label"))),
        entry("binary", F.col("gold_label"))))).alias("e")).select("e.check", "e.value")
    return C.domain_reports(stacked, {"two_label": PR.TWO_LABELS, "three_label": PR.THREE_LABELS, "binary": PR.BINARY})


def label_domain_report_sql() -> str:
    return f"""WITH {S.PAIRS},
t AS (SELECT 'two_label' AS "check", CASE WHEN quality = 1 THEN 'entailment' ELSE 'contradiction' END AS value FROM pairs
      UNION ALL
      SELECT 'three_label', CASE WHEN quality = 0 THEN 'contradiction' WHEN toxic = 1 THEN 'neutral' ELSE 'entailment' END
      FROM pairs WHERE language = 'en'
      UNION ALL
      SELECT 'binary', gold_label FROM pairs)
SELECT "check", value, count(*) AS n_rows,
       CASE "check" WHEN 'two_label' THEN value IN ('entailment', 'contradiction')
                    WHEN 'three_label' THEN value IN ('entailment', 'contradiction', 'neutral')
                    ELSE value IN ('entailment', 'not_entailment') END AS in_domain
FROM t GROUP BY "check", value"""


def row_count_report(spark: SparkSession, sf_dir: str, factory=fx.stub_factory) -> DataFrame:
    """CHK-2 / AGG-3: row-count conservation at each reshaping stage. Pairs and
    triples are written once; every count reads the few columns it needs. A
    prediction counts when its request has an answer."""
    ch = materialize(fx.choice_rows(spark, sf_dir), "triples")
    chp = PR.choice_to_pairs(ch, keep=["rid", "win_no"])
    p = materialize(fx.pairs(spark, sf_dir), "pairs")
    files = {"entailment": p.filter(F.col("gold_label") == "entailment").select("premise", "hypothesis"),
             "not_entailment": p.filter(F.col("gold_label") == "not_entailment").select("premise", "hypothesis")}
    un = PR.union_class_files(files)
    three = p.withColumn("gold_label", fx.three_label())
    three_out = PR.three_label_to_binary(three, language="en")
    pred = predictions(p, factory, _cfg(), [fx.STUB_MODEL], TASK, unknown="keep", checkpoint=False)\
        .filter(F.col("raw_answer").isNotNull())

    def tagged(check, side, df, mult=1):
        return df.agg((F.count(F.lit(1)) * F.lit(mult)).cast("bigint").alias("n"))\
                 .select(F.lit(check).alias("check"), F.lit(side).alias("side"), "n")

    three_en = three.filter(F.col("language") == "en")
    # ALN-1: equal counts do not prove a match -- one full outer join of the
    # expected (pair, run) keys against the prediction keys gives the counts
    # and the keys found on one side only, with the predictions computed once
    run_keys = [*KEYS, "model", "prompt_type"]
    expected_runs = expand_runs(p, run_specs(_cfg(), TASK, [fx.STUB_MODEL]), _cfg(), TASK, unknown="keep")
    al = C.alignment(expected_runs, pred, run_keys)
    parts = [tagged("choice_pairs_double", "expected", ch, 2),
             tagged("choice_pairs_double", "actual", chp),
             tagged("class_union_sum", "expected", files["entailment"]),
             tagged("class_union_sum", "expected", files["not_entailment"]),
             tagged("class_union_sum", "actual", un),
             tagged("three_label_filter", "expected", three_en),
             tagged("three_label_filter", "actual", three_out),
             tagged("predictions_per_prompt", "expected", p, len(_types())),
             al.select(F.lit("predictions_per_prompt").alias("check"), F.lit("actual").alias("side"),
                       F.col("n_actual").cast("bigint").alias("n")),
             tagged("alignment_unmatched", "expected", p, 0),
             al.select(F.lit("alignment_unmatched").alias("check"), F.lit("actual").alias("side"),
                       F.col("n_unmatched").alias("n"))]
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    side = F.col("side")
    report = counts.groupBy("check").agg(
        F.sum(F.when(side == "expected", F.col("n"))).cast("bigint").alias("expected"),
        F.sum(F.when(side == "actual", F.col("n"))).cast("bigint").alias("actual"))
    return report.select("check", "expected", "actual",
                         (F.col("expected") == F.col("actual")).alias("ok"))


def row_count_report_sql() -> str:
    n_types = len(_types())
    return f"""WITH {S.PAIRS}{S.TRIPLES}
SELECT 'choice_pairs_double' AS "check", CAST(2 * (SELECT count(*) FROM triples) AS BIGINT) AS expected,
       CAST(2 * (SELECT count(*) FROM triples) AS BIGINT) AS actual, TRUE AS ok
UNION ALL
SELECT 'class_union_sum', (SELECT count(*) FROM pairs), (SELECT count(*) FROM pairs), TRUE
UNION ALL
SELECT 'three_label_filter', (SELECT count(*) FROM pairs WHERE language = 'en'),
       (SELECT count(*) FROM pairs WHERE language = 'en'), TRUE
UNION ALL
SELECT 'predictions_per_prompt', {n_types} * (SELECT count(*) FROM pairs),
       {n_types} * (SELECT count(*) FROM pairs), TRUE
UNION ALL
SELECT 'alignment_unmatched', CAST(0 AS BIGINT), CAST(0 AS BIGINT), TRUE"""


def distinct_labels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4: distinct gold labels per dataset."""
    return distinct_labels(fx.pairs(spark, sf_dir), "gold_label", ["dataset"])


def distinct_labels_sql() -> str:
    return f"""WITH {S.PAIRS} SELECT DISTINCT dataset, gold_label FROM pairs"""


# ------------------------------------------------------------------ analyses
def original_vs_paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 + ANL-4: both text versions evaluated side by side. As in the
    reference's two-stage flow, the paraphrase table is generated once and
    stored (shared folder), then read as the second text version."""
    cfg = _cfg()
    original = materialize(fx.pairs(spark, sf_dir), "pairs")     # texts are split once
    stored = materialize(_paraphrased_pairs(original), "paraphrases")
    both = R.read_versions(spark, original, stored)
    pr = predictions(both, fx.stub_factory, cfg, [fx.STUB_MODEL], TASK, unknown="keep")
    return A.original_vs_paraphrase(pr, ["dataset", "model", "prompt_type"])


def original_vs_paraphrase_sql() -> str:
    return f"""WITH {S.PAIRS}{_paraphrased_sql()},
both_versions AS (SELECT dataset, pair_id, pair_no, language, premise, hypothesis, gold_label,
                         'original' AS text_version FROM pairs
                  UNION ALL
                  SELECT dataset, pair_id, pair_no, language, premise, hypothesis, gold_label,
                         'paraphrase' FROM para),
{_pred_sql('both_versions')},
agg AS (SELECT dataset, model, prompt_type,
               count(*) FILTER (WHERE text_version = 'original') AS n_original,
               count(*) FILTER (WHERE text_version = 'paraphrase') AS n_paraphrase,
               sum(CASE WHEN gold_label = prediction THEN 1 ELSE 0 END) FILTER (WHERE text_version = 'original') AS c_o,
               sum(CASE WHEN gold_label = prediction THEN 1 ELSE 0 END) FILTER (WHERE text_version = 'paraphrase') AS c_p
        FROM pred GROUP BY dataset, model, prompt_type)
SELECT dataset, model, prompt_type, n_original, n_paraphrase,
       CAST(c_o AS DOUBLE) / n_original AS acc_original,
       CAST(c_p AS DOUBLE) / n_paraphrase AS acc_paraphrase,
       CAST(c_p AS DOUBLE) / n_paraphrase - CAST(c_o AS DOUBLE) / n_original AS acc_delta
FROM agg"""


def matched_paraphrase_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANL-4 on matched pairs: what the paraphrase did to each pair's answer.
    An empty sentence has no paraphrase, so its pair has no partner."""
    original = materialize(fx.pairs(spark, sf_dir), "pairs")
    para = materialize(_paraphrased_pairs(original).filter("original_sentence <> ''"), "paraphrases")
    pr = predictions(R.read_versions(spark, original, para), fx.stub_factory, _cfg(), [fx.STUB_MODEL], TASK, unknown="keep")
    return A.matched_versions(pr, [*KEYS, "model", "prompt_type"], ["dataset", "model", "prompt_type"])


def matched_paraphrase_effect_sql() -> str:
    return f"""WITH {S.PAIRS}{_paraphrased_sql()},
both_versions AS (SELECT dataset, pair_id, pair_no, language, premise, hypothesis, gold_label, 'original' AS text_version FROM pairs
  UNION ALL SELECT dataset, pair_id, pair_no, language, premise, hypothesis, gold_label, 'paraphrase'
  FROM para WHERE original_sentence <> ''),
{_pred_sql('both_versions')},
each AS (SELECT dataset, pair_id, pair_no, model, prompt_type, text_version,
                coalesce(gold_label = prediction, FALSE) AS hit FROM pred),
m AS (SELECT coalesce(o.dataset, p.dataset) AS dataset, coalesce(o.model, p.model) AS model,
             coalesce(o.prompt_type, p.prompt_type) AS prompt_type, o.hit AS o, p.hit AS p
      FROM (SELECT * FROM each WHERE text_version = 'original') o
      FULL JOIN (SELECT * FROM each WHERE text_version = 'paraphrase') p
      ON o.dataset IS NOT DISTINCT FROM p.dataset AND o.pair_id = p.pair_id AND o.pair_no = p.pair_no
         AND o.model = p.model AND o.prompt_type = p.prompt_type)
SELECT dataset, model, prompt_type, count(*) FILTER (o AND p) AS n_right_right, count(*) FILTER (o AND NOT p) AS n_right_wrong,
  count(*) FILTER (NOT o AND p) AS n_wrong_right, count(*) FILTER (NOT o AND NOT p) AS n_wrong_wrong,
  count(*) FILTER (p IS NULL) AS n_only_original, count(*) FILTER (o IS NULL) AS n_only_paraphrase,
  CASE WHEN count(*) FILTER (o IS NOT NULL AND p IS NOT NULL) > 0 THEN
    CAST(count(*) FILTER (NOT o AND p) - count(*) FILTER (o AND NOT p) AS DOUBLE)
    / count(*) FILTER (o IS NOT NULL AND p IS NOT NULL) END AS matched_delta
FROM m GROUP BY dataset, model, prompt_type"""


def accuracy_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANL-1 + ANL-3: accuracy per bin of ten tokens (premise + hypothesis)."""
    return A.accuracy_by_length(_pred(spark, sf_dir, features=True), ["prompt_type"], 10)


def accuracy_by_length_sql() -> str:
    return f"""WITH {S.PAIRS}, {_pred_sql()},
f AS (SELECT *, CAST(floor(({S.token_count('premise')} + {S.token_count('hypothesis')}) / 10) AS BIGINT) AS length_bin
      FROM pred)
SELECT prompt_type, length_bin, {S.ACCURACY} FROM f GROUP BY prompt_type, length_bin"""


def accuracy_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANL-2 + ANL-3: accuracy per Jaccard decile of the two sentences."""
    return A.accuracy_by_overlap(_pred(spark, sf_dir, features=True), ["prompt_type"], 10)


def accuracy_by_overlap_sql() -> str:
    return f"""WITH {S.PAIRS}, {_pred_sql()},
f AS (SELECT *, coalesce(CAST(least(floor({S.jaccard('premise', 'hypothesis')} * 10), 9) AS BIGINT), -1) AS overlap_bin
      FROM pred)
SELECT prompt_type, overlap_bin, {S.ACCURACY} FROM f GROUP BY prompt_type, overlap_bin"""


# ---------------------------------------------------------------- round trips
PAIR_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("pair_id", T.LongType()),
    T.StructField("pair_no", T.LongType()), T.StructField("language", T.StringType()),
    T.StructField("premise", T.StringType()), T.StructField("hypothesis", T.StringType()),
    T.StructField("gold_label", T.StringType())])
PAIR_COLS = [f.name for f in PAIR_SCHEMA.fields]


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1 then SRC-1/SRC-4: quoted TSV written to the shared folder, read back."""
    path = new_shared_subdir(spark, "pairs-tsv") + "/pairs.tsv"
    K.write_tsv(fx.pairs(spark, sf_dir, labelled=False).select(*PAIR_COLS), path)
    return R.load_dataset(spark, path, PAIR_SCHEMA)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON Lines written to the shared folder, read back (SRC-3)."""
    path = new_shared_subdir(spark, "pairs-jsonl") + "/pairs.jsonl"
    K.write_json_lines(fx.pairs(spark, sf_dir, labelled=False).select(*PAIR_COLS), path)
    return R.load_dataset(spark, path, PAIR_SCHEMA)


def round_trip_sql() -> str:
    return f"""WITH {S.ALL_PAIRS} SELECT {', '.join(PAIR_COLS)} FROM pairs"""


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1 (comma) then SRC-1/SRC-5: quoted CSV written and read back."""
    path = new_shared_subdir(spark, "pairs-csv") + "/pairs.csv"
    K.write_csv(fx.pairs(spark, sf_dir, labelled=False).select(*PAIR_COLS), path)
    return R.load_dataset(spark, path, PAIR_SCHEMA)


def json_records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files of one list of records each, written and read back (SRC-2)."""
    path = new_shared_subdir(spark, "pairs-json") + "/pairs.json"
    K.write_json_records(fx.pairs(spark, sf_dir, labelled=False).select(*PAIR_COLS), path)
    return R.load_dataset(spark, path, PAIR_SCHEMA)


def load_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1/2 + FLT-1 + GRD-2: one dataset as TSV with role columns of its own
    in another order and a language, one as JSON Lines without; labels in mixed
    case; both loaded in English where a language is known."""
    base = new_shared_subdir(spark, "mixed-files")
    p = _one_line(fx.two_label_rows(spark, sf_dir))
    even = F.col("pair_id") % 2 == 0
    roles = ["label AS gold_label", "hypothesis AS sentence2", "language", "premise AS sentence1"]
    K.write_tsv(p.filter(even).selectExpr(*roles), f"{base}/even.tsv")
    K.write_json_lines(p.filter(~even).select("premise", "hypothesis", "label"), f"{base}/odd.jsonl")
    cfg = EvalConfig(datasets={
        "even": DatasetSpec(name="even", data_path=f"{base}/even.tsv", prem_col="sentence1", hyp_col="sentence2",
                            label_col="gold_label"),
        "odd": DatasetSpec(name="odd", data_path=f"{base}/odd.jsonl")}, models={}, prompts={})
    from .load import load_all
    got = load_all(spark, cfg, language="en", multiline=False)
    return got.select("dataset", "language", "premise", "hypothesis", "gold_label")


def load_mixed_files_sql() -> str:
    label = "CASE WHEN quality = 1 THEN 'entailment' ELSE 'contradiction' END AS gold_label"
    return f"""WITH {S.PAIRS}, one_line AS ({_one_line_sql()})
SELECT 'even' AS dataset, language, premise, hypothesis, {label.replace(' AS gold_label', '')} AS gold_label
FROM one_line WHERE pair_id % 2 = 0 AND language = 'en'
UNION ALL
SELECT 'odd', NULL, premise, hypothesis, {label} FROM one_line WHERE pair_id % 2 <> 0"""


def _config_file() -> dict:
    """A configuration that names some sources, one of them without the task."""
    sources = {"src0": [TASK], "src1": ["other"], "src2": ["other", TASK]}
    return {"datasets": {n: {"prompts": tasks} for n, tasks in sources.items()}, "models": {m: m for m in _grid_models()},
            "prompts": {TASK: {t: {"prefix": _prefix(t)} for t in _types()}}}


def config_tables_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: a configuration file read as tables and joined to the pairs:
    requests and prefix volume of every dataset by prompt type and model
    (none where the configuration plans no run)."""
    path = new_shared_subdir(spark, "config") + "/config.json"
    spark.createDataFrame([(json.dumps(_config_file()),)], "value string").write.text(path)
    runs = run_table(read_config_tables(spark, path, source=True), TASK)
    sizes = fx.pairs(spark, sf_dir, labelled=False).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pairs"))
    return sizes.join(runs, "dataset", "left").select(
        "dataset", "prompt_type", "model", "n_pairs", (F.col("n_pairs") * F.length("prefix")).alias("prefix_chars"))


def config_tables_grid_sql() -> str:
    names = ", ".join(S.lit(n) for n, d in _config_file()["datasets"].items() if TASK in d["prompts"])
    return f"""WITH {S.ALL_PAIRS},
sizes AS (SELECT dataset, count(*) AS n_pairs FROM pairs GROUP BY dataset),
runs AS (SELECT dataset, r.model, r.prompt_type, r.prefix
         FROM (SELECT unnest([{names}]) AS dataset) CROSS JOIN (SELECT * FROM {_runs_sql(_grid_models())}) r)
SELECT s.dataset, prompt_type, model, n_pairs, n_pairs * length(prefix) AS prefix_chars
FROM sizes s LEFT JOIN runs USING (dataset)"""


def class_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6 + PRE-2 from files: one headerless TSV per class, all read in one
    scan with a schema, labels restored from the file they came from."""
    base = new_shared_subdir(spark, "class-files")
    p = fx.pairs(spark, sf_dir)
    files = {}
    for label in PR.BINARY:
        path = f"{base}/{label}.tsv"
        K.write_tsv(p.filter(F.col("gold_label") == label).select("premise", "hypothesis"),
                    path, header=False)
        files[label] = path
    return C.assert_domain(read_class_files(spark, files, "premise string, hypothesis string"), "label", PR.BINARY)


def class_files_round_trip_sql() -> str:
    return f"""WITH {S.PAIRS} SELECT premise, hypothesis, gold_label AS label FROM pairs"""


PARA_COLS = ["premise", "hypothesis", "gold_label", "original_sentence", "changed_side"]


def paraphrase_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3 then SRC-8/PRJ-3: paraphrase tables written per side (last
    column original_premise / original_hypothesis) and loaded back as the
    paraphrase version of configured datasets."""
    base = new_shared_subdir(spark, "paraphrase-files")
    para = materialize(_paraphrased_pairs(fx.pairs(spark, sf_dir, labelled=False)).select(*PARA_COLS), "paraphrases")
    datasets = {}
    for side in ("p", "h"):
        path = f"{base}/side_{side}.tsv"
        K.write_tsv(K.paraphrase_frame(para.filter(F.col("changed_side") == side), side), path)
        datasets[f"para-{side}"] = DatasetSpec(name=f"para-{side}", data_path_paraphrase=path)
    cfg = EvalConfig(datasets=datasets, models={}, prompts={})
    from .load import load_all
    return load_all(spark, cfg, versions=("paraphrase",)).select(*PARA_COLS)


def paraphrase_tsv_round_trip_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}{_paraphrased_sql()} SELECT {', '.join(PARA_COLS)} FROM para"""


def stored_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2/SNK-4 + CHK-2 + AGG-2: the evaluation job -- predictions written
    once to the run-partitioned store with row conservation checked from
    counts observed during the write, accuracy read back from the store."""
    from .evaluate import run_evaluation
    out = new_shared_subdir(spark, "predictions")
    return run_evaluation(fx.pairs(spark, sf_dir), fx.stub_factory, _cfg(), [fx.STUB_MODEL], out,
                          TASK, run_id="fixture-run", by=["dataset", "language"], unknown="keep")


def stored_answers_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-1 with an answer store: the second pass has other prompt prefixes
    and must not get the first pass's answers."""
    store = new_shared_subdir(spark, "answers") + "/store"
    # both passes ask the same sentences; labels only say how often a pair's rows come, and meet digests
    pairs = fx.document_pairs(spark, sf_dir)
    asked = materialize(distinct_sentences(pairs.filter(allowed_for(F.col("dataset"), _cfg(), TASK, "keep"))), "pairs")
    p = fx.per_label(by_digest(pairs.select(*KEYS, "premise", "hypothesis")), spark, sf_dir)
    passes = []
    for n, extra in enumerate(("", RERUN_PREFIX)):
        cfg = _cfg()
        for t, spec in cfg.prompts[TASK].items():
            cfg.prompts[TASK][t] = replace(spec, prefix=extra + spec.prefix)
        pr = predictions(p, fx.stub_factory, cfg, [fx.STUB_MODEL], TASK, unknown="keep", store=store,
                         sentences=asked)
        passes.append(pr.select(F.lit(n).cast("bigint").alias("pass_no"), *KEYS, "prompt_type", "raw_answer"))
    return passes[0].unionByName(passes[1])


#: Shifts every prompt's length, by which the stand-in answers.
RERUN_PREFIX = "Again. "


def stored_answers_rerun_sql() -> str:
    prompt = S.pair_prompt('r.prompt_type', f"({S.lit(RERUN_PREFIX)} || r.prefix)")
    return f"""WITH {S.ALL_PAIRS}, {_pred_sql()},
again AS (SELECT p.*, r.prompt_type, {prompt} AS prompt FROM pairs p CROSS JOIN runs r)
SELECT CAST(0 AS BIGINT) AS pass_no, dataset, pair_id, pair_no, prompt_type, raw_answer FROM pred
UNION ALL
SELECT CAST(1 AS BIGINT), dataset, pair_id, pair_no, prompt_type, {S.stub_answer('prompt')} FROM again"""


PREDICTION_COLS = ["premise", "hypothesis", "gold_label", "prediction"]


def _predictions_tsv(spark, pairs: DataFrame, version: str) -> DataFrame:
    pr = predictions(pairs.withColumn("text_version", F.lit(version)), fx.stub_factory, _cfg(), [fx.STUB_MODEL],
                     TASK, unknown="keep")
    out = K.predictions_frame(pr, version)
    path = new_shared_subdir(spark, "predictions-tsv") + "/predictions.tsv"
    K.write_tsv(out, path)
    return R.load_dataset(spark, path, out.schema, multiline=False)


def predictions_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: the four-column predictions file of original text, read back."""
    return _predictions_tsv(spark, _one_line(fx.pairs(spark, sf_dir, labelled=False)), "original")


def predictions_tsv_round_trip_sql() -> str:
    return f"""WITH {S.ALL_PAIRS}, one_line AS ({_one_line_sql()}), {_pred_sql('one_line')}
SELECT {', '.join(PREDICTION_COLS)} FROM pred"""


def predictions5_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: the five-column predictions file of paraphrased text, read back."""
    para = materialize(_paraphrased_pairs(_one_line(fx.pairs(spark, sf_dir, labelled=False)))
                       .select("dataset", *PARA_COLS), "paraphrases")
    return _predictions_tsv(spark, para, "paraphrase")


def predictions5_tsv_round_trip_sql() -> str:
    para = _paraphrased_sql().replace("FROM pairs)", "FROM one_line)", 1)
    return f"""WITH {S.ALL_PAIRS}, one_line AS ({_one_line_sql()}){para}, {_pred_sql('para')}
SELECT {', '.join(PREDICTION_COLS)}, original_sentence AS paraphrased_sentence FROM pred"""


def _one_line(pairs: DataFrame) -> DataFrame:
    """Sentences without line breaks, so that their files can be split."""
    for c in ("premise", "hypothesis"):
        pairs = pairs.withColumn(c, F.translate(c, "\r\n", "  "))
    return pairs


def _one_line_sql() -> str:
    one = ", ".join(f"translate({c}, chr(13) || chr(10), '  ') AS {c}" for c in ("premise", "hypothesis"))
    return f"SELECT * REPLACE ({one}) FROM pairs"


QUERIES = {
    "accuracy_by_dataset": (accuracy_by_dataset, accuracy_by_dataset_sql),
    "generate_dedup": (generate_dedup, generate_dedup_sql),
    "answer_to_label": (answer_to_label_q, answer_to_label_sql),
    "clean_paraphrase": (clean_paraphrase_q, clean_paraphrase_sql),
    "choice_to_pairs": (choice_to_pairs, choice_to_pairs_sql),
    "union_labelled_files": (union_labelled_files, union_labelled_files_sql),
    "collapse_two_labels": (collapse_two_labels, collapse_two_labels_sql),
    "collapse_three_labels": (collapse_three_labels, collapse_three_labels_sql),
    "prompt_plain": (prompt_plain, prompt_plain_sql),
    "prompt_expert": (prompt_expert, prompt_expert_sql),
    "prompt_paraphrase": (prompt_paraphrase, prompt_paraphrase_sql),
    "prompt_chat": (prompt_chat, prompt_chat_sql),
    "run_grid": (run_grid, run_grid_sql),
    "reuse_runs": (reuse_runs, reuse_runs_sql),
    "reuse_runs_by_key": (reuse_runs_by_key, reuse_runs_by_key_sql),
    "substitute_paraphrase": (substitute_paraphrase_q, substitute_paraphrase_sql),
    "label_domain_report": (label_domain_report, label_domain_report_sql),
    "row_count_report": (row_count_report, row_count_report_sql),
    "distinct_labels": (distinct_labels_q, distinct_labels_sql),
    "original_vs_paraphrase": (original_vs_paraphrase, original_vs_paraphrase_sql),
    "matched_paraphrase_effect": (matched_paraphrase_effect, matched_paraphrase_effect_sql),
    "accuracy_by_length": (accuracy_by_length, accuracy_by_length_sql),
    "accuracy_by_overlap": (accuracy_by_overlap, accuracy_by_overlap_sql),
    "tsv_round_trip": (tsv_round_trip, round_trip_sql),
    "json_round_trip": (json_round_trip, round_trip_sql),
    "csv_round_trip": (csv_round_trip, round_trip_sql),
    "json_records_round_trip": (json_records_round_trip, round_trip_sql),
    "load_mixed_files": (load_mixed_files, load_mixed_files_sql),
    "config_tables_grid": (config_tables_grid, config_tables_grid_sql),
    "class_files_round_trip": (class_files_round_trip, class_files_round_trip_sql),
    "paraphrase_tsv_round_trip": (paraphrase_tsv_round_trip, paraphrase_tsv_round_trip_sql),
    "excluded_datasets": (excluded_datasets_q, excluded_datasets_sql),
    "reuse_sentences": (reuse_sentences, reuse_sentences_sql),
    "stored_answers_rerun": (stored_answers_rerun, stored_answers_rerun_sql),
    "predictions_tsv_round_trip": (predictions_tsv_round_trip, predictions_tsv_round_trip_sql),
    "predictions5_tsv_round_trip": (predictions5_tsv_round_trip, predictions5_tsv_round_trip_sql),
    "stored_accuracy": (stored_accuracy, accuracy_by_dataset_sql),
}


def queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v[1]() for k, v in QUERIES.items() if v[1] is not None}
