"""Row identity, stored answers and published runs can be relied on."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators.generate import generate
from pairlens.sources import readers as R
from pairlens.sources import sinks as K


def _echo(model):
    return lambda prompts: [f"{model}:{p}" for p in prompts]


def test_columns_are_bound_by_header_name(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.tsv")
    with open(p, "w") as f:
        f.write("label\tpremise\tnote\thypothesis\nentailment\tp\tn\th\n")
    for multiline in (True, False):
        got = R.load_dataset(spark, p, "premise string, hypothesis string, label string", multiline=multiline)
        assert [tuple(r) for r in got.collect()] == [("p", "h", "entailment")]
    with pytest.raises(KeyError):
        R.read_tsv(spark, p, "premise string, gold string")


def test_row_order_agrees_between_pruned_branches(spark, tmp_dir):
    rng, p = random.Random(3), os.path.join(tmp_dir, "big.tsv")
    with open(p, "w") as f:
        f.write("premise\thypothesis\n")
        f.writelines(f"{i}\t{'x' * rng.randrange(80)}{i}\n" for i in range(30_000))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = R.with_row_order(R.read_tsv(spark, p, "premise string, hypothesis string", multiline=False), "pair_id")
        assert df.rdd.getNumPartitions() > 3
        both = df.select("pair_id", "premise").join(df.select("pair_id", "hypothesis"), "pair_id", "full")
        wrong = both.filter("premise is null or hypothesis is null or not endswith(hypothesis, premise) "
                            "or cast(premise as bigint) <> pair_id").count()
        assert wrong == 0 and both.count() == 30_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_store_answers_belong_to_the_prompt_as_sent(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    df = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, text string")

    def answers(prefix):
        out = generate(df, _echo, F.concat(F.lit(prefix), "text"), ["model", "text"], store=store)
        return sorted(r.raw_answer for r in out.collect())
    assert answers("1 ") == ["m:1 a", "m:1 b"] and answers("2 ") == ["m:2 a", "m:2 b"] and answers("1 ") == ["m:1 a", "m:1 b"]
    assert spark.read.parquet(store).count() == 4


def test_a_stored_run_is_not_written_twice(spark, tmp_dir):
    df = spark.createDataFrame([("d", "m", "t", "original", "x")],
                               "dataset string, model string, prompt_type string, text_version string, prediction string")
    path = os.path.join(tmp_dir, "pred")
    K.write_predictions(df, path, run_id="r")
    with pytest.raises(ValueError):
        K.write_predictions(df, path, run_id="r")
    K.write_predictions(df, path)
    assert spark.read.parquet(path).count() == 2
    assert K.unique_run() != K.unique_run()


def test_missing_answers_fail_the_evaluation(spark, tmp_dir):
    from pairlens.plans import fixtures as fx
    from pairlens.plans.evaluate import run_evaluation
    pairs = fx.pairs(spark, "/root/testdata/sf0.001").limit(20)
    out = os.path.join(tmp_dir, "runs")
    with pytest.raises(ValueError, match="no answer"):
        run_evaluation(pairs, lambda m: lambda ps: [None] * len(ps), fx.fixture_config(), [fx.STUB_MODEL], out, unknown="keep")
    assert not os.path.exists(out)


def test_five_columns_only_for_paraphrases(spark):
    df = spark.createDataFrame([("p", "h", "g", "x", "o", v) for v in ("original", "paraphrase")],
                               "premise string, hypothesis string, gold_label string, prediction string, "
                               "original_sentence string, text_version string")
    assert len(K.predictions_frame(df).columns) == 4 and K.predictions_frame(df).count() == 1
    assert K.predictions_frame(df, "paraphrase").columns[-1] == "paraphrased_sentence"


def _small_cfg(prompts):
    from pairlens.config import DatasetSpec, default_config
    cfg = default_config()
    cfg.models["m"] = "m"
    cfg.datasets = {n: DatasetSpec(name=n, prompts=p) for n, p in prompts.items()}
    return cfg


def _small_pairs(spark, datasets):
    return spark.createDataFrame([(d, i, f"p{i}", f"h{i}", "entailment") for i, d in enumerate(datasets)],
                                 "dataset string, pair_id long, premise string, hypothesis string, gold_label string")


def _yes(model):
    return lambda prompts: ["yes"] * len(prompts)


def test_unknown_datasets_fail_and_excluded_ones_are_counted(spark, tmp_dir):
    from pairlens.operators.grid import excluded_datasets
    from pairlens.plans.evaluate import predictions, run_evaluation
    cfg = _small_cfg({"a": ("binary",), "b": ("other",)})
    with pytest.raises(Exception, match="not in the configuration"):
        predictions(_small_pairs(spark, ["a", "nosuch"]), _yes, cfg, ["m"]).collect()
    with pytest.raises(Exception, match="NULL"):
        predictions(_small_pairs(spark, ["a", None]), _yes, cfg, ["m"]).collect()
    n = len(cfg.prompt_types("binary"))
    assert predictions(_small_pairs(spark, ["a", "nosuch", None]), _yes, cfg, ["m"], unknown="keep").count() == 3 * n
    mixed = _small_pairs(spark, ["a", "b", "b"])
    assert [tuple(r) for r in excluded_datasets(mixed, cfg, "binary").collect()] == [("b", 2)]
    out = os.path.join(tmp_dir, "runs")
    with pytest.raises(ValueError, match="'b': 2"):
        run_evaluation(mixed, _yes, cfg, ["m"], out)
    assert not os.path.exists(out)
    assert run_evaluation(mixed, _yes, cfg, ["m"], out, skip_excluded=True).count() == n


def test_row_count_report_sees_missing_answers(spark):
    from pairlens.plans import catalog, fixtures as fx
    sf = "/root/testdata/sf0.001"
    assert all(r.ok for r in catalog.row_count_report(spark, sf).collect())

    def forgetful(model):
        answer = fx.stub_factory(model)
        return lambda prompts: [a if i % 7 else None for i, a in enumerate(answer(prompts))]
    bad = {r["check"]: r.ok for r in catalog.row_count_report(spark, sf, forgetful).collect()}
    assert not bad["predictions_per_prompt"] and not bad["alignment_unmatched"] and bad["choice_pairs_double"]


def test_a_hot_pair_is_split(spark):
    from pairlens.plans.evaluate import predictions
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pairs = spark.range(30_000, numPartitions=8).selectExpr(
            "'a' as dataset", "id as pair_id", "if(id % 3 = 0, 'hot', concat('p', id)) as premise",
            "if(id % 3 = 0, 'hot', concat('h', id)) as hypothesis", "'entailment' as gold_label")
        pr = predictions(pairs, _yes, _small_cfg({"a": ("binary",)}), ["m"], prompt_types=["qa-zero-ent"])
        rows = pr.select("pair_id", "raw_answer").collect()
        assert len(rows) == 30_000 and all(r.raw_answer == "yes" for r in rows)
        out = pr.select("pair_id", "raw_answer")
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_language_over_mixed_datasets(spark, tmp_dir):
    from pairlens.config import DatasetSpec, EvalConfig
    from pairlens.plans.load import load_all
    with open(os.path.join(tmp_dir, "a.tsv"), "w") as f:
        f.write("premise\thypothesis\tlabel\tlanguage\np\th\tx\ten\nq\ti\tx\tde\n")
    with open(os.path.join(tmp_dir, "b.jsonl"), "w") as f:
        f.write('{"premise": "r", "hypothesis": "j", "label": "X"}\n')
    cfg = EvalConfig(datasets={n: DatasetSpec(name=n, data_path=os.path.join(tmp_dir, n + s))
                               for n, s in (("a", ".tsv"), ("b", ".jsonl"))}, models={}, prompts={})
    for multiline in (True, False):
        got = load_all(spark, cfg, language="en", multiline=multiline).select("premise", "gold_label").collect()
        assert sorted(map(tuple, got)) == [("p", "x"), ("r", "x")]
    with pytest.raises(Exception, match="language"):
        load_all(spark, cfg, language="en", require_language=True).collect()
