"""How much a step writes and shuffles, and that its results don't depend on it."""

import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators.generate import _packed, generate
from pairlens.plans import fixtures as fx
from pairlens.plans.evaluate import predictions
from pairlens.sources import readers as R
from pairlens.sources import sinks as K

PAIRS = "dataset string, pair_id long, premise string, hypothesis string, gold_label string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exports_are_compressed_files_of_bounded_rows(spark, tmp_dir):
    rows = [(f"{i} a sentence\twith \"quotes\"", None if i % 7 == 0 else f"another sentence {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "premise string, hypothesis string").repartition(2)
    path = K.write_tsv(df, os.path.join(tmp_dir, "out.tsv"), rows_per_file=100)
    parts = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) >= 10 and all(f.endswith(".gz") for f in parts)
    assert sum(map(os.path.getsize, parts)) < 0.5 * sum(len(a) + len(b or "") for a, b in rows)
    for multiline in (False, True):
        got = [tuple(r) for r in R.load_dataset(spark, path, df.schema, multiline=multiline).collect()]
        assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_the_answers_of_a_pair_are_not_shuffled_to_group_them(spark):
    cfg = fx.fixture_config()
    cfg.models["other"] = "other"
    rows = [("d", i, f"premise {i % 30}", f"hypothesis {i % 30}", "entailment") for i in range(90)]
    rows += [("d", 90, None, "h", "x"), ("d", 91, "", "", "x")]
    pairs = spark.createDataFrame(rows, PAIRS)
    factory = lambda m: lambda ps: [f"{m}:{p}" for p in ps]     # noqa: E731
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")      # groups cross the batches
    try:
        for partitions in (None, 3):
            pr = predictions(pairs, factory, cfg, [fx.STUB_MODEL, "other"], unknown="keep", checkpoint=False,
                             batch_size=2, partitions=partitions)
            assert "collect_list" not in plan_of(pr) and "MapInPandas" in plan_of(pr)
            got = {(r.pair_id, r.model, r.prompt_type): r.raw_answer for r in pr.collect()}
            assert len(got) == 92 * 2 * len(cfg.prompt_types("binary"))
            for (i, m, t), a in got.items():
                if i == 90:
                    assert a is None
                else:
                    assert a.startswith(f"{m}:{cfg.prompt('binary', t).prefix}") and (i == 91 or f"hypothesis {i % 30}" in a)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_pair_goes_to_the_generator_once_without_prefixes(spark):
    cfg = fx.fixture_config()
    cfg.models["other"] = "other"
    texts = [(f"première {i % 20} \U0001f600\n->", f"{{h}}: %s {i % 20}") for i in range(60)] + [("", ""), (None, "h"), ("p", None)]
    pairs = spark.createDataFrame([("d", i, p, h, "entailment") for i, (p, h) in enumerate(texts)], PAIRS)

    def factory(model):
        def fn(prompts):
            assert isinstance(prompts, pd.Series) and list(prompts.index) == list(range(len(prompts))) and len(prompts) <= 3
            return [f"{model}|{p}" for p in prompts]
        return fn
    pr = predictions(pairs, factory, cfg, [fx.STUB_MODEL, "other"], unknown="keep", checkpoint=False, batch_size=3)
    plan = plan_of(pr)
    below = plan[plan.index("MapInPandas"):]
    assert "Say which is the inference" not in plan and "Generate explode" not in below, below
    got = {(r.pair_id, r.model, r.prompt_type): r.raw_answer for r in pr.collect()}
    assert len(got) == len(texts) * 2 * len(cfg.prompt_types("binary"))
    for (i, m, t), a in got.items():
        p, h = texts[i]
        layout = "\n Premise: {}\n Hypothesis: {}\n Answer: " if t == "chain" else " {} -> {}: "
        assert a == (None if p is None or h is None else f"{m}|{cfg.prompt('binary', t).prefix}{layout.format(p, h)}")


def test_a_broken_group_of_requests_is_an_error():
    run = lambda batches: iter(batches)      # noqa: E731
    frame = lambda keys: pd.DataFrame({"k": keys, "a": [f"{i}" for i in range(len(keys))]})      # noqa: E731
    whole = pd.concat(_packed(run, 2, "a")([frame([1, 1, 2]), frame([2])]))
    assert [(k, list(a)) for k, a in zip(whole["k"], whole["a"])] == [(1, ["0", "1"]), (2, ["2", "0"])]
    for bad in ([frame([1, 2])], [frame([1, 1, 2])]):
        with pytest.raises(ValueError):
            list(_packed(run, 2, "a")(bad))


def test_answers_come_back_without_the_texts_of_their_request(spark):
    long = "a sentence of more than sixteen bytes "
    rows = [(i, "m", f"{long}{i % 5}" if i % 6 else None, 1.0 * (i % 2)) for i in range(30)] + [(30, "m", "", 0.0), (31, None, "x", 0.0)]
    df = spark.createDataFrame(rows, "id int, model string, text string, kind double")
    prompt = F.concat(F.col("text"), F.lit("|"), F.col("kind").cast("string"))
    out = generate(df, lambda m: lambda ps: [f"{m}:{p}" for p in ps], prompt, ["model", "text", "kind"])
    join = re.search(r"Join \[(.*?)\], \[", plan_of(out)).group(1)
    assert "_req#" in join and "kind" in join and "text#" not in join
    got = {r.id: r.raw_answer for r in out.collect()}
    assert got == {i: None if t is None or m is None else f"{m}:{t}|{k}" for i, m, t, k in rows}


def test_an_evaluation_writes_its_predictions_once(spark, tmp_dir):
    from pairlens.plans.evaluate import run_evaluation
    from pairlens.session import shared_dir
    cfg, out = fx.fixture_config(), os.path.join(tmp_dir, "pred")
    n = len(cfg.prompt_types("binary"))
    pairs = spark.createDataFrame([(f"d{i % 2}", i, f"premise {i}", f"hypothesis {i}", "entailment") for i in range(40)], PAIRS)
    before = set(os.listdir(shared_dir(spark).replace("file:", "")))
    acc = run_evaluation(pairs, lambda m: lambda ps: ["yes"] * len(ps), cfg, [fx.STUB_MODEL], out, run_id="r", by=["dataset"],
                         unknown="keep")
    new = set(os.listdir(shared_dir(spark).replace("file:", ""))) - before
    assert sum(d.startswith("answers-") for d in new) == 1 and not any(d.startswith("predictions-") for d in new)
    assert sum(r.n_total for r in acc.collect()) == 40 * n == K.commits(spark, out).first().n_rows
    for d in ("d0", "d1"):      # rows of one folder still lie in one file
        for t in cfg.prompt_types("binary"):
            at = f"{out}/dataset={d}/model={fx.STUB_MODEL}/prompt_type={t}/run_id=r"
            assert sum(f.endswith(".parquet") for _, _, fs in os.walk(at) for f in fs) == 1


def test_matched_versions_multiply_the_copies_of_a_key(spark):
    from pairlens.operators.analysis import matched_versions
    hit = lambda right: ("entailment", "entailment" if right else "unk")     # noqa: E731
    rows = [("d", 1, "original", *hit(True)), ("d", 1, "original", *hit(False)), ("d", 1, "paraphrase", *hit(True)),
            ("d", 1, "paraphrase", *hit(True)), ("d", 1, "paraphrase", *hit(False)), (None, 2, "original", *hit(True)),
            (None, 2, "paraphrase", *hit(False)), ("d", 3, "original", *hit(True)), ("d", 3, "original", None, "unk"),
            ("d", 4, "paraphrase", *hit(False)), ("d", 1, None, *hit(True)), ("d", 5, "draft", *hit(True))]
    pred = spark.createDataFrame(rows, "dataset string, pair_id long, text_version string, gold_label string, prediction string")
    got = matched_versions(pred, ["dataset", "pair_id"], ["dataset"])
    assert "Join" not in plan_of(got)
    by = {r.dataset: tuple(r)[1:] for r in got.collect()}
    assert by == {"d": (2, 1, 2, 1, 2, 1, 1 / 6), None: (0, 1, 0, 0, 0, 0, -1.0)}


def test_a_rerun_has_the_rows_of_repeated_labels_and_writes_sentences_once(spark, tmp_dir, monkeypatch):
    import duckdb

    from pairlens.plans import catalog
    texts = ["A one. B two. C three", "A one. B two. C three", None, "", "single", "D four. E five"]
    docs = [(i if i < 5 else None, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    labels = [(0, 1, 0), (0, 0, 1), (3, 1, 1), (None, 1, 0), (9, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_dir}/labels.parquet")
    written, own = [], catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, prefix: (written.append(df.columns), own(df, prefix))[1])
    got = catalog.stored_answers_rerun(spark, tmp_dir)
    assert written == [["premise", "hypothesis"]]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_dir}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.stored_answers_rerun_sql()).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want)) and len(want) == 2 * 5 * 10


def test_the_answers_of_a_pair_are_one_text_in_the_shuffle(spark):
    rows = [("d", i, f"premise {i % 30}", f"hypothesis {i % 30}", "entailment") for i in range(90)]
    pr = predictions(spark.createDataFrame(rows, PAIRS), lambda m: lambda ps: [f"{p[-9:]}\u0001" for p in ps], fx.fixture_config(),
                     [fx.STUB_MODEL], unknown="keep")
    plan = plan_of(pr)
    answers = plan[plan.rindex("Exchange"):]
    assert "array_join" in answers and "split(" not in answers and "array_join" not in plan[:plan.rindex("Exchange")]
    assert all(r.raw_answer.endswith("\u0001") for r in pr.collect())
