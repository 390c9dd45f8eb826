"""Property tests: the JVM-side parsers agree with Python's string semantics
on arbitrary text (batched: one Spark job per generated sample list)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions.answers import answer_to_label, clean_paraphrase
from pairlens.functions.text import token_count
from pyoracle import first_label, first_sentence

SPECIAL = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　​.,0123456789"
ALPHABET = st.sampled_from(list(SPECIAL) + list("yesnoYESNO") + ["é", "ß", "Σ", "x"])
TEXT = st.text(alphabet=ALPHABET, max_size=24)
MAP = {"yes": "entailment", "no": "not_entailment", "yesno": "both"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=50, max_size=200))
def test_parsers_agree_with_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", answer_to_label("t", MAP).alias("label"),
                     clean_paraphrase("t").alias("clean"),
                     token_count("t").alias("n")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.label == first_label(t, MAP), repr(t)
        assert r.clean == first_sentence(t), repr(t)
        assert r.n == len(t.split()), repr(t)
