import pytest
from pyspark.sql import functions as F

from pairlens.operators import checks as C
from pairlens.operators import prepare as PR


def test_choice_to_pairs_order_and_labels(spark):
    df = spark.createDataFrame([(1, "s", "e1", "e2", 0), (2, "t", "f1", "f2", 1)],
                               "rid int, startphrase string, ending1 string, ending2 string, labels int")
    out = [tuple(r) for r in PR.choice_to_pairs(df, keep=["rid"]).orderBy("rid", "choice_no").collect()]
    assert out == [(1, 0, "s", "e1", "entailment"), (1, 1, "s", "e2", "not_entailment"),
                   (2, 0, "t", "f2", "entailment"), (2, 1, "t", "f1", "not_entailment")]


@pytest.mark.parametrize("bad", [-1, 2, None])
def test_choice_label_outside_domain_fails(spark, bad):
    df = spark.createDataFrame([("s", "a", "b", bad)],
                               "startphrase string, ending1 string, ending2 string, labels int")
    with pytest.raises(Exception, match="choice label"):
        PR.choice_to_pairs(df).collect()


def test_union_class_files_keeps_duplicates(spark):
    a = spark.createDataFrame([("p", "h"), ("p", "h")], "premise string, hypothesis string")
    b = spark.createDataFrame([("q", "k")], "premise string, hypothesis string")
    out = PR.union_class_files({"entailment": a, "not_entailment": b})
    assert out.count() == 3
    assert sorted(r.label for r in out.collect()) == ["entailment", "entailment", "not_entailment"]


def test_two_label_to_binary(spark):
    df = spark.createDataFrame([("Entailment",), ("CONTRADICTION",)], "label string")
    out = [tuple(r) for r in PR.two_label_to_binary(df).collect()]
    assert out == [("entailment", "entailment"), ("not_entailment", "contradiction")]
    bad = spark.createDataFrame([("neutral",)], "label string")
    with pytest.raises(Exception, match="source labels"):
        PR.two_label_to_binary(bad).collect()


def test_three_label_to_binary_filters_language(spark):
    df = spark.createDataFrame([("en", "neutral"), ("en", "entailment"), ("es", "contradiction"),
                                ("en", "contradiction")], "language string, gold_label string")
    out = [tuple(r) for r in PR.three_label_to_binary(df).collect()]
    assert out == [("en", "not_entailment", "neutral"), ("en", "entailment", "entailment"),
                   ("en", "not_entailment", "contradiction")]
    assert PR.three_label_to_binary(df, language=None).count() == 4
    with pytest.raises(Exception):
        PR.three_label_to_binary(spark.createDataFrame([("en", "Neutral")], "language string, gold_label string")).collect()


def test_filter_language_requires_column(spark):
    df = spark.createDataFrame([("a",)], "premise string")
    with pytest.raises(KeyError):
        PR.filter_language(df, "en")
    assert PR.filter_language(df, "en", require=False).count() == 1
    assert PR.filter_language(df, None).count() == 1


def test_role_columns_and_fold(spark):
    df = spark.createDataFrame([("a", "b", "ENTAILMENT", "original"), ("c", "d", "Entailment", "paraphrase")],
                               "sentence1 string, sentence2 string, gold_label string, v string")
    r = PR.role_columns(df, "sentence1", "sentence2", "gold_label", keep=["v"])
    out = r.select(PR.fold_label(F.col("label"), F.col("v")).alias("l")).collect()
    assert [x.l for x in out] == ["entailment", "Entailment"]
    with pytest.raises(KeyError):
        PR.role_columns(df, "premise", "sentence2", "gold_label")


def test_domain_report_and_enforce(spark):
    df = spark.createDataFrame([("entailment",), ("other",), (None,)], "label string")
    rep = {(r.value, r.in_domain) for r in C.domain_report(df, "label", PR.BINARY, "x").collect()}
    assert rep == {("entailment", True), ("other", False), (None, False)}
    with pytest.raises(AssertionError):
        C.enforce(C.domain_report(df, "label", PR.BINARY, "x"), "in_domain")
    with pytest.raises(Exception):
        C.assert_domain(df, "label", PR.BINARY).collect()
    C.enforce(C.domain_report(df.limit(0), "label", PR.BINARY, "x"), "in_domain")  # empty passes


def test_unmatched_both_sides(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert {r.side: r.n for r in C.unmatched(a, b, ["k"]).collect()} == {"left_only": 1, "right_only": 2}


def test_observed_counts_check_conservation(spark, tmp_dir):
    import os
    df = spark.createDataFrame([(i, "s", "a", "b", i % 2) for i in range(10)],
                               "rid int, startphrase string, ending1 string, ending2 string, labels int")
    src, n_in = C.observed_count(df, "choice_in")
    out, n_out = C.observed_count(PR.choice_to_pairs(src, keep=["rid"]), "choice_out")
    out.write.parquet(os.path.join(tmp_dir, "out"))          # one pass counts both
    C.check_conservation(2 * n_in.get["n_rows"], n_out.get["n_rows"], "two-choice reshape")
    with pytest.raises(AssertionError):
        C.check_conservation(n_in.get["n_rows"], n_out.get["n_rows"], "x")


def test_alignment_counts(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,), (5,)], "k int")
    r = C.alignment(a, b, ["k"]).first()
    assert (r.n_expected, r.n_actual, r.n_unmatched) == (3, 4, 3)
