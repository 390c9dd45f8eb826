import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions.answers import answer_to_label, answer_to_label_by, clean_paraphrase
from pyoracle import first_label, first_sentence

MAP = {"yes": "entailment", "no": "not_entailment"}
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
          " ", " ", " ", " ", " ", " ", " ", " ", "　"]
NON_SPACES = ["​", "᠎", "﻿", "\x00", "\x07"]
WORDS = ["yes", "no", "Yes", "NO", "..yes", "no,", ".,no.,", "yes!", '"yes"', "maybe", "nope",
         "not_entailment", "y.es", ".", ",", "", "noo", "YES.", "5", "12", "1a", "x.y", "é", "İ"]


def _rand_text(rng):
    parts = []
    for _ in range(rng.randint(0, 6)):
        parts.append(rng.choice(WORDS + NON_SPACES))
        parts.append("".join(rng.choice(SPACES) for _ in range(rng.randint(0, 2))))
    return "".join(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = ["Yes.", "no", "I think no, yes", "yes!", "", "Sure. Yes,", "other", "..NO.,",
            "  yes", "yes　no", " no", "x\x1cyes", "no​yes"]
    return base + [_rand_text(rng) for _ in range(3000)]


def test_answer_to_label_regex_and_array_paths_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = F.create_map(*[F.lit(x) for kv in MAP.items() for x in kv])
    got = df.select("i", answer_to_label("t", MAP).alias("a"),
                    answer_to_label("t", m).alias("b")).collect()
    for r in got:
        want = first_label(texts[r.i], MAP)
        assert r.a == want, (texts[r.i], r.a, want)
        assert r.b == want, (texts[r.i], r.b, want)


def test_answer_to_label_edge_keys(spark):
    # keys the regex path cannot take fall back to the token-array path
    mapping = {"": "empty", ".x": "dot", "a b": "space", "ok": "fine"}
    texts = ["..", "ok", ".x", "a b", "  , ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.a for r in df.select(answer_to_label("t", mapping).alias("a")).collect()]
    assert got == [first_label(t, mapping) for t in texts]


def test_answer_to_label_null_is_unknown(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(answer_to_label("t", MAP).alias("a")).first().a == "unk"


def test_answer_to_label_by_prompt_type(spark):
    maps = {"qa": MAP, "nli": {"entailment": "entailment", "other": "not_entailment"}}
    df = spark.createDataFrame([("qa", "Yes."), ("nli", "Other!"), ("nli", "other."),
                                ("qa", "entailment")], "k string, t string")
    got = [r.a for r in df.select(answer_to_label_by("t", "k", maps).alias("a")).collect()]
    assert got == ["entailment", "unk", "not_entailment", "unk"]
    bad = spark.createDataFrame([("zzz", "yes")], "k string, t string")
    with pytest.raises(Exception):
        bad.select(answer_to_label_by("t", "k", maps)).collect()


def test_clean_paraphrase_matches_python(spark):
    rng = random.Random(11)
    pool = ["1. ", "12", "5", "a.", "Hello", " world", ". ", "3x", "\n", "\r\n", "\x0b", "\x1c", "\x85",
            " ", "　", "\x1f", "Paraphrase: ", "99.", "é", "\t"]
    texts = ["", "5", "12", "1. The sky is blue. Another.", "\nfirst empty", "  2) spaced  ",
             "abc def", "x\x1fy"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", clean_paraphrase("t").alias("c")).collect():
        assert r.c == first_sentence(texts[r.i]), (repr(texts[r.i]), r.c, first_sentence(texts[r.i]))
