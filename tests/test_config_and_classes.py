"""Configurations as joined tables, class files in one scan, matched versions."""

import json
import os

import pytest

from pairlens.operators.analysis import matched_versions
from pairlens.sources import sinks as K
from pairlens.sources.class_files import read_class_files
from pairlens.sources.config import read_config_tables, run_table, unconfigured, unknown_names


def config(datasets, models, prompts):
    return {"datasets": {n: {"prompts": t} for n, t in datasets.items()}, "models": {m: f"org/{m}" for m in models},
            "prompts": {t: {p: {"prefix": f"{t}/{p}"} for p in types} for t, types in prompts.items()}}


def write(folder, **configs):
    os.makedirs(folder, exist_ok=True)
    for name, c in configs.items():
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(c, f, indent=1)
    return folder


def test_runs_are_joined_within_a_configuration(spark, tmp_dir):
    one = config({"a": ["t1", "t2"], "b": ["t2", "t2"], "c": []}, ["m", "n"], {"t1": ["x", "y"], "t2": ["z"]})
    two = config({"a": ["t1", "nosuch"]}, ["o"], {"t1": ["x"]})
    path = write(f"{tmp_dir}/configs", one=one, two=two)
    tables = read_config_tables(spark, path, source=True)
    runs = run_table(tables)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = sorted((os.path.basename(r.config), r.dataset, r.task, r.prompt_type, r.prefix, r.model_id) for r in runs.collect())
    want = sorted([("one.json", d, t, p, f"{t}/{p}", f"org/{m}") for m in "mn" for d, t, p in (
        ("a", "t1", "x"), ("a", "t1", "y"), ("a", "t2", "z"), ("b", "t2", "z"))] + [("two.json", "a", "t1", "x", "t1/x", "org/o")])
    assert got == want
    assert run_table(tables, "t2").count() == 4
    assert [(r.dataset, r.task) for r in unknown_names(tables).collect()] == [("a", "nosuch")]
    rows = spark.createDataFrame([("a",), ("q",), ("q",), (None,)], "dataset string")
    assert sorted(map(repr, (tuple(r) for r in unconfigured(rows, tables).collect()))) == sorted(map(repr, [("q", 2), (None, 1)]))


def test_another_configuration_gives_another_grid(spark, monkeypatch):
    from pairlens.plans import catalog
    sf = "/root/testdata/sf0.001"
    first = {(r.dataset, r.prompt_type, r.model) for r in catalog.config_tables_grid(spark, sf).collect()}
    other = catalog._config_file()
    other["models"] = {"only": "org/only"}
    other["datasets"] = {"src1": {"prompts": ["binary"]}}
    monkeypatch.setattr(catalog, "_config_file", lambda: other)
    second = {(r.dataset, r.prompt_type, r.model) for r in catalog.config_tables_grid(spark, sf).collect()}
    assert {m for d, _, m in second if d == "src1"} == {"only"} and {m for d, _, m in second if d != "src1"} == {None}
    assert {m for d, _, m in first if d == "src1"} == {None}


def test_five_hundred_class_files_in_one_scan(spark, tmp_dir):
    files, want = {}, []
    for i in range(500):
        name = f"{tmp_dir}/class {i}+%.tsv" if i % 7 == 0 else f"{tmp_dir}/c{i}.tsv"
        with open(name, "w") as f:
            f.write(f'p{i % 3}\t"h\n{i}"\np{i % 3}\t"h\n{i}"\n')        # a duplicate row, and a line break
        files[f"label {i}"] = name
        want += [(f"p{i % 3}", f"h\n{i}", f"label {i}")] * 2
    df = read_class_files(spark, files, "premise string, hypothesis string")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_class_folders_and_lists(spark, tmp_dir):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "")], "premise string, hypothesis string")
    K.write_tsv(rows, f"{tmp_dir}/one", header=False)
    K.write_tsv(rows.limit(1), f"{tmp_dir}/two", header=False)
    K.write_tsv(rows.limit(1), f"{tmp_dir}/three", header=False)
    got = read_class_files(spark, {"x": f"{tmp_dir}/one", "y": [f"{tmp_dir}/two", f"{tmp_dir}/three"]}, rows.schema)
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a", "b", "x")] * 2 + [("c", "", "x")] + [("a", "b", "y")] * 2)
    with pytest.raises(ValueError):
        read_class_files(spark, {"x": f"{tmp_dir}/one", "y": f"{tmp_dir}/one"}, rows.schema)


def test_matched_versions_count_each_pair_once(spark):
    rows = [("original", "d", 1, "e", "e"), ("paraphrase", "d", 1, "e", "n"), ("original", "d", 2, "e", "n"),
            ("paraphrase", "d", 2, "e", "e"), ("original", "d", 3, "e", "e"), ("paraphrase", "d", 3, "e", "e"),
            ("original", "d", 4, "e", None), ("paraphrase", "d", 4, "e", "n"), ("original", "d", 5, "e", "e"),
            ("paraphrase", None, 6, "e", "e"), ("original", None, 7, None, "e"), ("paraphrase", None, 7, "e", "e")]
    pred = spark.createDataFrame(rows, "text_version string, dataset string, pair_id long, gold_label string, prediction string")
    got = {r.dataset: tuple(r)[1:] for r in matched_versions(pred, ["dataset", "pair_id"], ["dataset"]).collect()}
    # right/right, right/wrong, wrong/right, wrong/wrong, only original, only paraphrase, delta
    assert got == {"d": (1, 1, 1, 1, 1, 0, 0.0), None: (0, 0, 1, 0, 0, 1, 1.0)}
