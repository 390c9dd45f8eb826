import json
import os

import pytest

from pairlens.config import EvalConfig, default_config
from pairlens.sources import readers as R
from pairlens.sources import sinks as K
from pairlens.sources.config import read_config_tables

PAIR = "premise string, hypothesis string"

# invented rows: doubled quotes, trailing space, non-ASCII quotes and dashes,
# a duplicate row, words that look like missing values
QUIRKS = [
    '"She painted  the shed  , all of it ! """\tShe painted a wall !',
    'The ferry was late and  crowded \tThe train was late and crowded',
    'He said “go” — and left\tHe said “stay” — and left',
    'Seven  geese  crossed the road ,\tSeven ducks crossed the road ,',
    'Seven  geese  crossed the road ,\tSeven ducks crossed the road ,',
    'None\tnull',
]


def test_headerless_tsv_quirks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "manual.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(QUIRKS) + "\n")
    rows = [tuple(r) for r in R.read_tsv(spark, path, PAIR, header=False).collect()]
    assert rows[0] == ('She painted  the shed  , all of it ! "', "She painted a wall !")
    assert rows[1][0].endswith("crowded ")
    assert rows[2][0] == "He said “go” — and left"
    assert rows[3] == rows[4]
    assert rows[5] == ("None", "null")        # words stay text
    assert len(rows) == 6


def test_format_dispatch(spark):
    assert R.format_of("a/b.tsv") == "tsv"
    assert R.format_of("a/b.jsonl") == "jsonl"
    assert R.format_of("x.csv") == "csv"
    assert R.format_of("x.gz", "csv") == "csv"
    for bad in ("x.tsv.gz", "X.TSV", "noext"):
        with pytest.raises(ValueError):
            R.format_of(bad)


def test_json_records_and_lines(spark, tmp_dir):
    recs = [{"premise": "a", "hypothesis": "b", "label": "Entailment"},
            {"premise": "c\td", "hypothesis": "e\nf", "label": "contradiction"}]
    p1 = os.path.join(tmp_dir, "d.json")
    with open(p1, "w") as f:
        json.dump(recs, f)
    p2 = os.path.join(tmp_dir, "d.jsonl")
    with open(p2, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    schema = "premise string, hypothesis string, label string"
    a = [tuple(r) for r in R.load_dataset(spark, p1, schema).collect()]
    b = [tuple(r) for r in R.load_dataset(spark, p2, schema).collect()]
    assert a == b == [tuple(r.values()) for r in recs]


def test_language_filter_on_load(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.tsv")
    with open(p, "w") as f:
        f.write("language\tgold_label\tsentence1\tsentence2\nen\tneutral\ta\tb\nes\tentailment\tc\td\n")
    schema = "language string, gold_label string, sentence1 string, sentence2 string"
    assert R.load_dataset(spark, p, schema, language="en").count() == 1
    with pytest.raises(KeyError):
        R.load_dataset(spark, p, "gold_label string", language="en", fmt="tsv")


def test_tsv_round_trip_hard_text(spark, tmp_dir):
    rows = [("tab\there", 'quote " inside', "x"), ("line\nbreak", "", None),
            ("  spaces  ", '""', "null"), ("NA", "None", "")]
    df = spark.createDataFrame(rows, "premise string, hypothesis string, gold_label string")
    path = K.write_tsv(df, os.path.join(tmp_dir, "out.tsv"))
    back = [tuple(r) for r in R.read_tsv(spark, path, "premise string, hypothesis string, gold_label string").collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)


def test_row_order_follows_file(spark, tmp_dir):
    p = os.path.join(tmp_dir, "o.tsv")
    with open(p, "w") as f:
        f.write("premise\thypothesis\n" + "".join(f"s{i}\th{i}\n" for i in range(500)))
    df = R.with_row_order(R.read_tsv(spark, p, PAIR, multiline=False))
    got = [r.premise for r in df.orderBy("row_ord").collect()]
    assert got == [f"s{i}" for i in range(500)]


def test_versions_union(spark):
    a = spark.createDataFrame([("p", "h", "entailment")], "premise string, hypothesis string, gold_label string")
    b = spark.createDataFrame([("p2", "h", "entailment", "p")],
                              "premise string, hypothesis string, gold_label string, original_sentence string")
    out = R.read_versions(spark, a, b)
    assert sorted((r.text_version, r.original_sentence) for r in out.collect()) == \
        [("original", None), ("paraphrase", "p")]


def test_predictions_store_partitioned(spark, tmp_dir):
    df = spark.createDataFrame([("d", "m", "t", "original", "p", "h", "entailment", "unk")],
                               "dataset string, model string, prompt_type string, text_version string, "
                               "premise string, hypothesis string, gold_label string, prediction string")
    path = K.write_predictions(df, os.path.join(tmp_dir, "pred"), run_id="01-01-2026_00_00_00")
    assert os.path.isdir(os.path.join(path, "dataset=d", "model=m", "prompt_type=t",
                                      "text_version=original", "run_id=01-01-2026_00_00_00"))
    assert K.predictions_frame(df).columns == ["premise", "hypothesis", "gold_label", "prediction"]
    assert K.paraphrase_frame(df.withColumn("original_sentence", df.premise), "h").columns[-1] == "original_hypothesis"


def test_config_reader(spark, tmp_dir):
    raw = {"datasets": {"flute": {"data_path": "x.tsv", "prem_col": "premise", "hyp_col": "hypothesis",
                                  "label_col": "label", "prompts": ["binary"]}},
           "models": {"m": "org/m"},
           "prompts": {"binary": {"qa": {"preffix": "Q?", "label_mapping": {"yes": "entailment"}}}}}
    p = os.path.join(tmp_dir, "config.json")
    with open(p, "w") as f:
        json.dump(raw, f, indent=2)
    t = read_config_tables(spark, p)
    assert [tuple(r) for r in t["prompts"].collect()] == [("binary", "qa", "Q?", {"yes": "entailment"})]
    assert t["datasets"].first().prompts == ["binary"]
    cfg = EvalConfig.from_json(p)
    assert cfg.prompt("binary", "qa").prefix == "Q?"
    with pytest.raises(KeyError):
        cfg.model("missing")
    with pytest.raises(KeyError):
        cfg.dataset("meta4xnli_all")
    d = default_config()
    assert set(d.prompt_types("binary")) == {"nli-zero", "nli-few", "qa-zero-ent", "qa-few-ent", "chain"}


def test_both_json_layouts_load_alike(spark, tmp_dir):
    """pandas writes columns by default, records on demand; both give the same rows."""
    import pandas as pd
    pdf = pd.DataFrame({"premise": ["a", None, '{"0": "x"}', "é\n"] * 6, "hypothesis": ["1", "[2]", "", "z"] * 6,
                        "n": list(range(24)), "other": ["-"] * 24})
    schema = "premise string, hypothesis string, n bigint, absent string"
    want = [tuple(None if v is None else v for v in r) + (None, i) for i, r in
            enumerate(pdf[["premise", "hypothesis", "n"]].itertuples(index=False, name=None))]
    for name, options in (("columns", {}), ("records", {"orient": "records"}), ("one", {"orient": "records"})):
        path = os.path.join(tmp_dir, f"{name}.json")
        (pdf.head(1) if name == "one" else pdf).to_json(path, **options)
        got = R.load_dataset(spark, path, schema, order_col="nr").orderBy("nr").collect()
        assert [tuple(r) for r in got] == (want[:1] if name == "one" else want), name
    lists = os.path.join(tmp_dir, "lists.json")
    with open(lists, "w") as f:
        json.dump(pdf.to_dict("list"), f)
    assert [tuple(r) for r in R.load_dataset(spark, lists, schema, order_col="nr").orderBy("nr").collect()] == want
    # a folder of both, read in one scan
    both = os.path.join(tmp_dir, "both.json")
    os.makedirs(both)
    pdf.head(10).to_json(os.path.join(both, "a.json"))
    pdf.tail(14).to_json(os.path.join(both, "b.json"), orient="records")
    df = R.load_dataset(spark, both, schema, order_col="nr")
    assert [tuple(r) for r in df.orderBy("nr").collect()] == want
    assert R.load_dataset(spark, both, schema)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_column_layout_with_uneven_columns(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cols.json")
    with open(p, "w") as f:
        json.dump({"premise": {"x": "a", "y": "b"}, "hypothesis": {"y": "d", "z": None, "w": "e"}}, f)
    got = R.load_dataset(spark, p, PAIR, order_col="nr").collect()
    assert sorted(map(repr, (tuple(r)[:2] for r in got))) == sorted(map(repr, [("a", None), ("b", "d"), (None, None), (None, "e")]))
    assert sorted(r.nr for r in got) == [0, 1, 2, 3]
    with open(p, "w") as f:
        json.dump({"premise": {"0": "a"}, "n": {"0": "seven"}}, f)
    with pytest.raises(Exception):
        R.load_dataset(spark, p, "premise string, n bigint").collect()


def test_json_records_in_many_files(spark, tmp_dir):
    rows = [(str(i), None if i % 7 == 0 else 'a "b"\n{[é') for i in range(53)]
    df = spark.createDataFrame(rows, PAIR).repartition(3)
    d = K.write_json_records(df, os.path.join(tmp_dir, "recs.json"), rows_per_file=5)
    files = [f for f in os.listdir(d) if f.startswith("part-")]
    assert len(files) >= 11
    for name in files:
        with open(os.path.join(d, name), encoding="utf-8") as f:
            assert len(json.load(f)) <= 5
    assert sorted(tuple(r) for r in R.load_dataset(spark, d, PAIR).collect()) == sorted(rows)
    # a file of columns among many
    with open(os.path.join(d, "part-z.json"), "w") as f:
        f.write('\n \t\n{"premise": {"0": "a"}, "hypothesis": {"0": "c"}}')
    assert sorted(tuple(r) for r in R.load_dataset(spark, d, PAIR).collect() if r.hypothesis) == sorted(
        [r for r in rows if r[1]] + [("a", "c")])


def test_row_order_across_files_and_splits(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    expect = []
    for k in range(3):
        with open(os.path.join(d, f"part-{k}.tsv"), "w") as f:
            f.write("premise\thypothesis\n")
            for i in range(2000 * (k + 1)):
                f.write(f"f{k}-{i}\th\n")
                expect.append(f"f{k}-{i}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")    # force several splits per file
    try:
        df = R.with_row_order(R.read_tsv(spark, d, PAIR, multiline=False))
        got = [r.premise for r in df.orderBy("row_ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expect
