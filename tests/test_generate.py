import os

import pandas as pd
from pyspark.sql import functions as F

from pairlens.operators.generate import generate, substitute_paraphrase


def _counting_factory(log_dir):
    def factory(model):
        def fn(prompts):
            import uuid
            with open(os.path.join(log_dir, f"calls-{uuid.uuid4().hex}"), "a") as f:
                for p in prompts:
                    f.write(p.replace("\n", " ") + "\n")
            return [f"{model}:{p.upper()}" for p in prompts]
        return fn
    return factory


def _calls(log_dir):
    out = []
    for name in os.listdir(log_dir):
        with open(os.path.join(log_dir, name)) as f:
            out += f.read().splitlines()
    return out


def test_generate_dedupes_and_keeps_rows(spark, tmp_dir):
    rows = [(i, "m1", ["a", "b", "a", None, "c"][i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, model string, prompt string")
    out = generate(df, _counting_factory(tmp_dir)).collect()
    assert len(out) == 50                       # nothing dropped, NULL prompt kept
    by = {r.id: r.raw_answer for r in out}
    assert by[0] == "m1:A" and by[3] is None and by[4] == "m1:C"
    assert sorted(_calls(tmp_dir)) == ["a", "b", "c"]    # one call per distinct request


def test_generate_with_rendered_prompt_keys(spark, tmp_dir):
    df = spark.createDataFrame([(1, "m", "p", "h"), (2, "m", "p", "h"), (3, "m", "p", "x")],
                               "id int, model string, premise string, hypothesis string")
    out = generate(df, _counting_factory(tmp_dir),
                   prompt=F.concat_ws("|", "premise", "hypothesis"),
                   keys=["model", "premise", "hypothesis"])
    assert {r.id: r.raw_answer for r in out.collect()} == {1: "m:P|H", 2: "m:P|H", 3: "m:P|X"}
    assert sorted(_calls(tmp_dir)) == ["p|h", "p|x"]


def test_generate_store_answers_each_request_once(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    os.makedirs(log)
    store = os.path.join(tmp_dir, "store")
    df1 = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, prompt string")
    generate(df1, _counting_factory(log), store=store).collect()
    df2 = spark.createDataFrame([("m", "a"), ("m", "c")], "model string, prompt string")
    out = {r.prompt: r.raw_answer for r in generate(df2, _counting_factory(log), store=store).collect()}
    assert out == {"a": "m:A", "c": "m:C"}
    assert sorted(_calls(log)) == ["a", "b", "c"]


def test_substitute_paraphrase(spark):
    df = spark.createDataFrame([("P", "H", "x", "p"), ("P", "H", "y", "h")],
                               "premise string, hypothesis string, paraphrase string, side string")
    out = substitute_paraphrase(df, F.col("side")).collect()
    assert [(r.premise, r.hypothesis, r.original_sentence, r.changed_side) for r in out] == \
        [("x", "H", "P", "p"), ("P", "y", "H", "h")]


def test_generate_batch_size_and_partitions(spark, tmp_dir):
    sizes = []

    def factory(model):
        def fn(prompts):
            import uuid
            with open(os.path.join(tmp_dir, f"b-{uuid.uuid4().hex}"), "w") as f:
                f.write(str(len(prompts)))
            return list(prompts)
        return fn
    df = spark.range(100).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("prompt"))
    out = generate(df, factory, batch_size=7, partitions=3)
    assert sorted(int(r.raw_answer) for r in out.collect()) == list(range(100))
    for name in os.listdir(tmp_dir):
        with open(os.path.join(tmp_dir, name)) as f:
            sizes.append(int(f.read()))
    assert max(sizes) <= 7 and sum(sizes) == 100


def test_generate_checkpoint_calls_once(spark, tmp_dir):
    df = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, prompt string")
    out = generate(df, _counting_factory(tmp_dir), checkpoint=True)
    out.collect()
    out.collect()          # answers are read back from storage, not regenerated
    assert sorted(_calls(tmp_dir)) == ["a", "b"]


def test_hot_request_join_is_split_by_aqe(spark, tmp_dir):
    """One request holds a third of all rows: dedupe collapses it map-side
    and AQE splits the skewed partition of the join back."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.localShuffleReader.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        df = spark.range(n).select(
            F.lit("m").alias("model"),
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("prompt"),
            F.col("id"))
        out = generate(df, _counting_factory(tmp_dir))
        rows = out.collect()
        assert len(rows) == n
        assert sum(1 for r in rows if r.raw_answer == "m:HOT") == n // 3
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        assert _calls(tmp_dir).count("hot") == 1
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_shared_dir_prefers_session_setting(spark):
    from pairlens.session import materialize, shared_dir
    base = shared_dir(spark)
    assert base and shared_dir(spark, "x").endswith("/x")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].find(base.replace("file:", "")) >= 0


def test_generator_answers_are_text(spark):
    import numpy as np

    def factory(model):
        return lambda prompts: [7, None, np.str_("x"), float("nan")][:len(prompts)]
    df = spark.createDataFrame([("m", p) for p in "abcd"], "model string, prompt string")
    out = {r.prompt: r.raw_answer for r in generate(df, factory, batch_size=4, partitions=1).collect()}
    assert sorted(out.values(), key=str) == sorted(["7", None, "x", None], key=str)
