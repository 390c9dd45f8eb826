"""The answer store: what a lookup reads and moves, and whose answer counts."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from pairlens.operators import answer_store as A
from pairlens.operators.generate import generate
from pairlens.plans import fixtures as fx
from pairlens.plans.evaluate import predictions

PAIRS = "dataset string, pair_id long, premise string, hypothesis string, gold_label string"


def counting(log):
    def factory(model):
        def fn(prompts):
            import uuid
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(str(len(prompts)))
            return [f"{model}:{len(p)}" for p in prompts]
        return fn
    return factory


def calls(log):
    total = 0
    for name in os.listdir(log):
        with open(os.path.join(log, name)) as f:
            total += int(f.read())
    return total


def pairs_of(spark, ids):
    return spark.createDataFrame([("d", i, f"premise {i}", f"hypothesis {i}", "entailment") for i in ids], PAIRS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def asked_of(spark, rows):
    return spark.createDataFrame(rows, "model string, text string").select("model", A.digest_of(F.col("text")).alias("digest"))


@pytest.fixture
def log(tmp_dir):
    os.makedirs(f"{tmp_dir}/log")
    return f"{tmp_dir}/log"


def test_a_pass_reads_only_its_models_and_buckets(spark, tmp_dir):
    store = A.AnswerStore(spark, f"{tmp_dir}/store")
    rows = [(m, f"t{i}") for m in ("a", "b") for i in range(300)]
    store.add(asked_of(spark, rows).withColumn("raw_answer", F.lit("x")), "raw_answer")
    assert len(os.listdir(f"{tmp_dir}/store/model=m-a")) > 30
    one = store.relevant(asked_of(spark, [("a", "t5"), ("a", "t77")]), 2)
    wanted = sorted({int.from_bytes(hashlib.sha256(t.encode()).digest()[:1]) % A.BUCKETS for t in ("t5", "t77")})
    plan = plan_of(one)
    read = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "(model#" in read and "= m-a)" in read and "m-b" not in read
    assert all(re.search(rf"\b{b}\b", read) for b in wanted) and "BroadcastHashJoin" in plan
    # no other folder is opened: without them the same answers come
    for m in os.listdir(f"{tmp_dir}/store"):
        for b in os.listdir(f"{tmp_dir}/store/{m}") if "=" in m else []:
            if m != "model=m-a" or int(b.split("=")[1]) not in wanted:
                for f in os.listdir(f"{tmp_dir}/store/{m}/{b}"):
                    if not f.startswith("."):
                        with open(f"{tmp_dir}/store/{m}/{b}/{f}", "wb") as out:
                            out.write(b"unreadable")
    assert one.count() == 2             # the hashes of the requests keep the rest of a bucket out


def test_lookups_move_no_sentence(spark, tmp_dir, log, monkeypatch):
    """Every exchange of a lookup carries digests, answers and run columns only."""
    import pairlens.session as session
    seen, own = [], session.materialize

    def spy(df, prefix):
        if prefix == "looked-up":
            seen.append(plan_of(df))
        return own(df, prefix)
    monkeypatch.setattr(session, "materialize", spy)
    pairs, cfg = pairs_of(spark, range(40)), fx.fixture_config()
    for _ in range(2):
        predictions(pairs, counting(log), cfg, [fx.STUB_MODEL], store=f"{tmp_dir}/store", unknown="keep").count()
    assert len(seen) == 1 and "digest#" in seen[0] and not re.search(r"premise|hypothesis|_prompt", seen[0])


def test_only_new_requests_are_asked(spark, tmp_dir, log):
    cfg, store = fx.fixture_config(), f"{tmp_dir}/store"
    cfg.models["other"] = "other"
    n = len(cfg.prompt_types("binary"))

    def run(ids, models):
        pr = predictions(pairs_of(spark, ids), counting(log), cfg, models, store=store, unknown="keep")
        return {(r.pair_id, r.model, r.prompt_type): r.raw_answer for r in pr.collect()}
    first = run(range(10), [fx.STUB_MODEL])
    assert calls(log) == 10 * n and len(first) == 10 * n
    more = run(range(5, 15), [fx.STUB_MODEL])
    assert calls(log) == 15 * n                         # half of them were stored
    assert all(more[k] == v for k, v in first.items() if k in more)
    run(range(10), [fx.STUB_MODEL, "other"])
    assert calls(log) == 25 * n                         # another model's answers are its own
    assert all(v == first[k] for k, v in run(range(10), [fx.STUB_MODEL]).items()) and calls(log) == 25 * n


def test_prompts_are_the_same_with_and_without_a_store(spark, tmp_dir, log):
    cfg, pairs = fx.fixture_config(), pairs_of(spark, range(8)).unionByName(
        spark.createDataFrame([("d", 90, None, "h", "x"), ("d", 91, "", "", "x"), ("d", 92, "", "", "x")], PAIRS))
    for chat in (False, True):
        def answer(**options):
            pr = predictions(pairs, lambda m: lambda ps: [str(p) for p in ps], cfg, [fx.STUB_MODEL], chat=chat,
                             unknown="keep", **options)
            return sorted(map(repr, (tuple(r) for r in pr.collect())))
        assert answer() == answer(store=f"{tmp_dir}/store-{chat}") == answer(store=f"{tmp_dir}/store-{chat}")


def test_the_earliest_answer_counts(spark, tmp_dir, monkeypatch):
    store = A.AnswerStore(spark, f"{tmp_dir}/store")
    asked = asked_of(spark, [("a", "t"), (None, "t"), ("", "t")])
    for at, answer in ((5, "late"), (3, "first"), (9, "last")):
        monkeypatch.setattr(A.time, "time_ns", lambda at=at: at)
        store.add(asked.withColumn("raw_answer", F.lit(answer)), "raw_answer")
    got = store.look_up(asked, 3, "raw_answer").collect()
    assert sorted((r.model or "", r.raw_answer) for r in got) == [("", "first"), ("", "first"), ("a", "first")]
    assert all(r.known for r in got)
    assert [tuple(r)[2:] for r in store.look_up(asked_of(spark, [("b", "t")]), 1, "raw_answer").collect()] == [(None, False)]


def test_prompt_types_of_one_template_ask_once(spark, tmp_dir, log):
    from dataclasses import replace
    cfg = fx.fixture_config()
    types = cfg.prompt_types("binary")
    cfg.prompts["binary"]["nli-few"] = replace(cfg.prompts["binary"]["nli-few"], prefix=cfg.prompts["binary"]["nli-zero"].prefix)
    for _ in range(2):
        pr = predictions(pairs_of(spark, range(5)), counting(log), cfg, [fx.STUB_MODEL], store=f"{tmp_dir}/store", unknown="keep")
        got = {(r.pair_id, r.prompt_type): r.raw_answer for r in pr.collect()}
        assert len(got) == 5 * len(types) and None not in got.values()
        assert all(got[i, "nli-few"] == got[i, "nli-zero"] for i in range(5)) and calls(log) == 5 * (len(types) - 1)


def test_an_unreadable_store_is_an_error(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/store")
    with open(f"{tmp_dir}/store/part-0.parquet", "w") as f:
        f.write("no parquet")
    df = spark.createDataFrame([("m", "a")], "model string, prompt string")
    with pytest.raises(Exception):
        generate(df, lambda m: lambda ps: list(ps), store=f"{tmp_dir}/store").collect()


def test_a_pair_is_one_row_of_the_store_and_another_prefix_moves_nothing(spark, tmp_dir, log, monkeypatch):
    from dataclasses import replace

    import pairlens.session as session
    written, own = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, prefix: (written.append(prefix), own(df, prefix))[1])
    cfg, store = fx.fixture_config(), f"{tmp_dir}/store"
    n = len(cfg.prompt_types("binary"))
    for extra in ("", "Again. "):
        for t, spec in cfg.prompts["binary"].items():
            cfg.prompts["binary"][t] = replace(spec, prefix=extra + spec.prefix)
        pr = predictions(pairs_of(spark, range(40)), counting(log), cfg, [fx.STUB_MODEL], store=store, unknown="keep")
        want = {t: len(f"{cfg.prompt('binary', t).prefix}") for t in cfg.prompt_types("binary")}
        for r in pr.collect():
            layout = "\n Premise: \n Hypothesis: \n Answer: " if r.prompt_type == "chain" else "  -> : "
            assert r.raw_answer == f"{fx.STUB_MODEL}:{want[r.prompt_type] + len(layout + r.premise + r.hypothesis)}"
    assert calls(log) == 2 * 40 * n
    assert spark.read.parquet(store).count() == 2 * 40          # not one for each pair and run
    assert written == ["answered", "answered"]                  # no pairs, no lookup


def test_runs_of_several_lists_are_found(spark, tmp_dir, log):
    cfg, store = fx.fixture_config(), f"{tmp_dir}/store"
    cfg.models["other"] = "other"
    types = cfg.prompt_types("binary")

    def run(ids, models, types, factory=counting(log)):
        pr = predictions(pairs_of(spark, ids), factory, cfg, models, store=store, unknown="keep", prompt_types=types)
        return {(r.pair_id, r.model, r.prompt_type): r.raw_answer for r in pr.collect()}
    none = lambda m: lambda ps: [None] * len(ps)      # noqa: E731
    run(range(4), [fx.STUB_MODEL], types[:1], none)                 # a missing answer is an answer
    run(range(6), [fx.STUB_MODEL], types[1:3])
    assert calls(log) == 6 * 2
    got = run(range(8), ["other", fx.STUB_MODEL], types[:3])        # 4 pairs lack other's, 2 one more, 2 all
    assert calls(log) == 6 * 2 + 4 * 3 + 2 * 4 + 2 * 6 and len(got) == 8 * 6
    assert all((a is None) == (m != "other" and t == types[0] and i < 4) for (i, m, t), a in got.items())
    again = run(range(8), [fx.STUB_MODEL, "other"], types[2::-1])
    assert again == got and calls(log) == 44
    assert run(range(2, 9), [fx.STUB_MODEL, "other"], types[:3]) == {
        **{k: v for k, v in got.items() if k[0] >= 2},
        **run([8], [fx.STUB_MODEL, "other"], types[:3])} and calls(log) == 44 + 6


def test_the_earliest_answer_of_a_pair_counts(spark, tmp_dir, monkeypatch):
    store, runs = A.AnswerStore(spark, f"{tmp_dir}/store"), [("a", "t1"), (None, "t2")]
    pairs = spark.createDataFrame([(bytes([i]) * 16,) for i in range(3)], "p binary")
    for at, two in ((5, ["late", "late"]), (3, ["first", None]), (9, ["last", "last"])):
        monkeypatch.setattr(A.time, "time_ns", lambda at=at: at)
        store.add_runs(pairs.limit(2).withColumn("a", F.array(*map(F.lit, two))), runs, "p", "a")
    assert store.rows(A.LIST_SCHEMA, A.LISTS).count() == 2
    lists = store.lists_with([("b", "t1"), (None, "t2"), ("a", "t1")])
    assert [*lists.values()] == [[2, 1]] and not store.lists_with([("b", "t1")])
    got = store.look_up_runs(pairs, 3, lists, "p").collect()
    assert sorted((bytes(r.p)[0], r.by_run) for r in got) == [(i, {2: "first", 1: None}) for i in (0, 1)]
    # the same for answers by prompt, where other requests have none
    asked = asked_of(spark, [("a", "t"), ("a", "u"), ("a", "v")])
    for answer in ("x", "y"):
        store.add(asked.limit(1).withColumn("raw_answer", F.lit(answer)), "raw_answer")
    known, n = store.known(asked, 3, "raw_answer")
    assert n == 1 and [r.raw_answer for r in known.collect()] == ["x"]


def test_answers_by_prompt_of_an_earlier_store_are_found(spark, tmp_dir, log):
    from pairlens.operators.grid import grid_prompt, run_specs
    from pairlens.plans import evaluate as E
    cfg, store = fx.fixture_config(), f"{tmp_dir}/store"
    types = cfg.prompt_types("binary")
    specs = run_specs(cfg, "binary", [fx.STUB_MODEL])
    templates = E._template_digests(spark, specs, grid_prompt(specs))
    for t in types[:2]:
        digest = A.digest_of(F.concat(F.lit(templates[t]), F.hex(E._pair_digest())))
        A.AnswerStore(spark, store).add(pairs_of(spark, range(5)).select(F.lit(fx.STUB_MODEL).alias("model"), digest.alias("digest"),
                                                                         F.lit(f"old {t}").alias("a")), "a")
    for _ in range(2):
        pr = predictions(pairs_of(spark, range(7)), counting(log), cfg, [fx.STUB_MODEL], store=store, unknown="keep")
        got = {(r.pair_id, r.prompt_type): r.raw_answer for r in pr.collect()}
        assert calls(log) == 5 * (len(types) - 2) + 2 * len(types) and len(got) == 7 * len(types)
        assert {k for k, a in got.items() if a.startswith("old")} == {(i, t) for i in range(5) for t in types[:2]}


def test_packed_answers_come_back_as_they_were(spark):
    odd = ["", "yes", None, "\u0001", "\u0002", "\u0003", "\u00033\u00031", "a\u0001b\u0002", "\u00031", "\u00032\u0003", "\\1$1\n", "\U0001f600"]
    rows = [(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)] + [(-1, None), (-2, [None]), (-3, [""])]
    df = spark.createDataFrame(rows, "i int, a array<string>")
    packed = df.withColumn("p", A.pack_answers(F.col("a")))
    assert dict(packed.dtypes)["p"] == "string" and packed.select("p").distinct().count() == len(rows)
    assert all(r.a == r.b for r in packed.withColumn("b", A.unpack_answers(F.col("p"))).collect())
