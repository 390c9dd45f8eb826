from pyspark.sql import functions as F

from pairlens.config import default_config
from pairlens.functions.prompts import chat_prompt, pair_prompt, pair_texts, paraphrase_prompt


def test_prompt_layouts_match_python_formatting(spark):
    cfg = default_config()
    p, h = "The sky wept.", "It rained."
    df = spark.createDataFrame([(p, h)], "premise string, hypothesis string")
    chain = cfg.prompt("binary", "chain").prefix
    qa = cfg.prompt("binary", "qa-zero-ent").prefix
    para = cfg.prompt("paraphrase_gen", "instruct").prefix
    r = df.select(pair_prompt("chain", F.lit(chain), "premise", "hypothesis").alias("a"),
                  pair_prompt("qa-zero-ent", F.lit(qa), "premise", "hypothesis").alias("b"),
                  paraphrase_prompt(F.lit(para), F.col("premise")).alias("c"),
                  chat_prompt(F.lit("chain"), F.lit(chain), "premise", "hypothesis").alias("d"),
                  chat_prompt(F.lit("qa-zero-ent"), F.lit(qa), "premise", "hypothesis").alias("e")).first()
    assert r.a == chain + f"\n Premise: {p}\n Hypothesis: {h}\n Answer: "
    assert r.b == qa + f" {p} -> {h}: "
    assert r.c == para + f" Original sentence: {p} Paraphrase: "
    assert [tuple(m) for m in r.d] == [("system", chain), ("user", f"Premise: {p}\n Hypothesis: {h}\n Answer:")]
    assert [tuple(m) for m in r.e] == [("system", qa), ("user", f" {p} -> {h}: ")]


def test_missing_text_gives_null_prompt(spark):
    df = spark.createDataFrame([(None, "h")], "premise string, hypothesis string")
    assert df.select(pair_prompt("x", F.lit("P"), "premise", "hypothesis").alias("a")).first().a is None


def test_prompts_made_in_a_task_are_those_of_the_column(spark):
    rows = [("The sky wept.", "It rained."), ("", ""), ("é\U0001f600 {p}", "%s\n->: "), (None, "h"), ("p", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, premise string, hypothesis string").orderBy("i")
    for t in ("chain", "qa-zero-ent"):
        for prefix in ("Say: {p}", "", None):
            want = [r.a for r in df.select(pair_prompt(t, F.lit(prefix).cast("string"), "premise", "hypothesis").alias("a")).collect()]
            assert pair_texts(t, prefix, *zip(*rows)) == want
