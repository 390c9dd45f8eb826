import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.config import EvalConfig, default_config
from pairlens.plans.evaluate import evaluate, predictions
from pairlens.plans.load import load_all, load_pairs
from pairlens.plans.paraphrase import paraphrase_pairs


def _cfg(tmp_dir):
    d = default_config()
    raw = {"datasets": {
        "meta": {"data_path": os.path.join(tmp_dir, "meta.tsv"),
                 "data_path_paraphrase": os.path.join(tmp_dir, "meta_para.tsv"),
                 "prem_col": "sentence1", "hyp_col": "sentence2", "label_col": "gold_label",
                 "prompts": ["binary", "paraphrase_gen"]},
        "fig": {"data_path": os.path.join(tmp_dir, "fig.json"), "prem_col": "premise",
                "hyp_col": "hypothesis", "label_col": "label", "prompts": ["binary"]}},
        "models": {"echo": "echo"},
        "prompts": {"binary": {t: {"preffix": p.prefix, "label_mapping": p.label_mapping}
                               for t, p in d.prompts["binary"].items()},
                    "paraphrase_gen": {"instruct": {"preffix": d.prompts["paraphrase_gen"]["instruct"].prefix}}}}
    with open(os.path.join(tmp_dir, "meta.tsv"), "w") as f:
        f.write("language\tgold_label\tsentence1\tsentence2\n"
                "en\tEntailment\tA b.\tC d.\nes\tNeutral\tE f.\tG h.\nen\tNeutral\tA b.\tX y.\n")
    with open(os.path.join(tmp_dir, "meta_para.tsv"), "w") as f:
        f.write("premise\thypothesis\tgold_label\toriginal_premise\nz\tC d.\tentailment\tA b.\n")
    with open(os.path.join(tmp_dir, "fig.json"), "w") as f:
        json.dump([{"premise": "P", "hypothesis": "H", "label": "ENTAILMENT"}], f)
    return EvalConfig.from_dict(raw)


def yes_factory(model):
    def fn(prompts):
        return ["yes." if "A b" in p else "No" for p in prompts]
    return fn


def para_factory(model):
    def fn(prompts):
        return [f"1. {p.split('Original sentence: ')[1][:-13].upper()}\nmore" for p in prompts]
    return fn


def test_load_pairs_original_and_paraphrase(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    o = load_pairs(spark, cfg, "meta", language="en").orderBy("pair_id").collect()
    assert [(r.premise, r.gold_label, r.language) for r in o] == \
        [("A b.", "entailment", "en"), ("A b.", "neutral", "en")]
    p = load_pairs(spark, cfg, "meta", "paraphrase").first()
    assert (p.premise, p.original_sentence, p.changed_side, p.gold_label) == ("z", "A b.", "p", "entailment")
    j = load_pairs(spark, cfg, "fig").first()
    assert (j.premise, j.gold_label, j.language) == ("P", "entailment", None)
    assert load_all(spark, cfg, versions=("original",)).count() == 4
    with pytest.raises(ValueError):
        load_pairs(spark, cfg, "fig", "paraphrase")
    with pytest.raises(Exception, match="language"):
        load_pairs(spark, cfg, "fig", language="en").collect()
    assert load_pairs(spark, cfg, "fig", language="en", require_language=False).count() == 1


def test_evaluate_end_to_end(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    pairs = load_all(spark, cfg).withColumn(
        "gold_label", F.when(F.col("gold_label") == "neutral", "not_entailment").otherwise(F.col("gold_label")))
    acc = {(r.dataset, r.prompt_type): (r.n_total, r.n_correct)
           for r in evaluate(pairs, yes_factory, cfg, ["echo"], by=["dataset"],
                             prompt_types=["qa-zero-ent", "nli-zero"]).collect()}
    # qa: "yes." -> entailment for the two "A b." rows, "No" -> not_entailment otherwise
    assert acc[("meta", "qa-zero-ent")] == (3, 2)
    assert acc[("meta", "nli-zero")] == (3, 0)        # yes/no are not nli keys -> unk
    assert acc[("fig", "qa-zero-ent")] == (1, 0)


def test_paraphrase_both_reuse_modes(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    pairs = load_pairs(spark, cfg, "meta")
    a = paraphrase_pairs(pairs, para_factory, "echo", "p", cfg, reuse="distinct")
    b = paraphrase_pairs(pairs, para_factory, "echo", "p", cfg, reuse="consecutive")
    ra = sorted((r.pair_id, r.premise, r.original_sentence) for r in a.collect())
    rb = sorted((r.pair_id, r.premise, r.original_sentence) for r in b.collect())
    assert ra == rb
    assert [x[1] for x in ra] == ["A B", "E F", "A B"]
    raw = paraphrase_pairs(pairs, para_factory, "echo", "h", cfg, clean=False).orderBy("pair_id").first()
    assert raw.hypothesis == "1. C D.\nmore" and raw.changed_side == "h"


def test_run_evaluation_writes_and_checks(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    pairs = load_all(spark, cfg)
    from pairlens.plans.evaluate import run_evaluation
    out = os.path.join(tmp_dir, "pred")
    acc = run_evaluation(pairs, yes_factory, cfg, ["echo"], out, prompt_types=["qa-zero-ent"],
                         run_id="r1")
    got = {(r.dataset, r.language): (r.n_total, r.n_correct) for r in acc.collect()}
    assert got == {("meta", "en"): (2, 1), ("meta", "es"): (1, 0), ("fig", None): (1, 0)}
    assert os.path.isdir(os.path.join(out, "dataset=meta", "model=echo", "prompt_type=qa-zero-ent",
                                      "text_version=original", "run_id=r1"))


def test_stored_accuracy_keeps_paraphrase_sources_apart(spark, tmp_dir):
    from pairlens.plans.evaluate import run_evaluation
    from pairlens.plans.paraphrase import paraphrase_pairs
    cfg = _cfg(tmp_dir)
    cfg.models["other"] = "other"
    pairs = load_pairs(spark, cfg, "meta")
    assert pairs.filter("paraphrase_source IS NOT NULL").isEmpty()
    both = [paraphrase_pairs(pairs, yes_factory, m, "p", cfg) for m in ("echo", "other")]
    acc = run_evaluation(both[0].unionByName(both[1]), yes_factory, cfg, ["echo"], os.path.join(tmp_dir, "pred"),
                         prompt_types=["qa-zero-ent"])
    got = {(r.language, r.paraphrase_source): r.n_total for r in acc.collect()}
    assert got == {("en", "echo"): 2, ("en", "other"): 2, ("es", "echo"): 1, ("es", "other"): 1}


def chat_factory(model):
    def fn(messages):
        out = []
        for m in messages:
            roles = [x["role"] for x in m]
            user = m[1]["content"]
            assert roles == ["system", "user"]
            out.append("yes" if "A b" in user else "no")
        return out
    return fn


def test_chat_predictions(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    pr = predictions(load_pairs(spark, cfg, "meta"), chat_factory, cfg, ["echo"],
                     prompt_types=["chain"], chat=True)
    got = sorted((r.premise, r.prediction) for r in pr.collect())
    assert got == [("A b.", "entailment"), ("A b.", "entailment"), ("E f.", "not_entailment")]


def test_load_pairs_checks_text_and_labels(spark, tmp_dir):
    cfg = _cfg(tmp_dir)
    with open(os.path.join(tmp_dir, "meta.tsv"), "w") as f:
        f.write("language\tgold_label\tsentence1\tsentence2\nen\tentailment\tA b.\t\n")
    with pytest.raises(Exception, match="missing value"):
        load_pairs(spark, cfg, "meta").collect()
    assert load_pairs(spark, cfg, "meta", require_text=False).first().hypothesis is None
    with open(os.path.join(tmp_dir, "meta.tsv"), "w") as f:
        f.write("language\tgold_label\tsentence1\tsentence2\nen\tneutral\tA b.\tC d.\n")
    with pytest.raises(Exception, match="outside"):
        load_pairs(spark, cfg, "meta", label_domain=("entailment", "not_entailment")).collect()


def test_consecutive_reuse_from_file_calls_once_per_run(spark, tmp_dir):
    import uuid
    log = os.path.join(tmp_dir, "calls")
    os.makedirs(log)

    def counting(model):
        def fn(prompts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(p.split("Original sentence: ")[1] for p in prompts))
            return [f"1. {p.split('Original sentence: ')[1][:-13].upper()}" for p in prompts]
        return fn
    cfg = _cfg(tmp_dir)
    with open(os.path.join(tmp_dir, "meta.tsv"), "w") as f:
        f.write("language\tgold_label\tsentence1\tsentence2\n"
                "en\tentailment\tSame one.\tH1.\nen\tentailment\tSame one.\tH2.\n"
                "en\tentailment\tOther.\tH3.\nen\tentailment\tSame one.\tH4.\n")
    out = paraphrase_pairs(load_pairs(spark, cfg, "meta"), counting, "echo", "p", cfg,
                           reuse="consecutive").orderBy("pair_id").collect()
    assert [r.premise for r in out] == ["SAME ONE", "SAME ONE", "OTHER", "SAME ONE"]
    calls = []
    for name in os.listdir(log):
        with open(os.path.join(log, name)) as f:
            calls += [c for c in f.read().split("\n") if c]
    assert len(calls) == 3          # runs: [Same one x2], [Other], [Same one]


def test_run_evaluation_reruns_reuse_the_answer_store(spark, tmp_dir):
    import uuid
    from pairlens.plans.evaluate import run_evaluation
    log = os.path.join(tmp_dir, "calls")
    os.makedirs(log)

    def counting(model):
        def fn(prompts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(str(len(prompts)))
            return ["yes" for _ in prompts]
        return fn

    def n_calls():
        total = 0
        for name in os.listdir(log):
            with open(os.path.join(log, name)) as f:
                total += int(f.read())
        return total
    cfg = _cfg(tmp_dir)
    pairs = load_all(spark, cfg)
    store = os.path.join(tmp_dir, "answers")
    a1 = run_evaluation(pairs, counting, cfg, ["echo"], os.path.join(tmp_dir, "p1"),
                        prompt_types=["qa-zero-ent"], run_id="r1", store=store).collect()
    first = n_calls()
    assert first == 4          # distinct (premise, hypothesis): A b./C d., E f./G h., A b./X y., P/H
    a2 = run_evaluation(pairs, counting, cfg, ["echo"], os.path.join(tmp_dir, "p2"),
                        prompt_types=["qa-zero-ent"], run_id="r2", store=store).collect()
    assert n_calls() == first  # the rerun reads every answer from the store
    key = lambda r: (r.dataset, r.language or "")
    assert sorted((key(r), r.n_total, r.n_correct) for r in a1) == \
        sorted((key(r), r.n_total, r.n_correct) for r in a2)
