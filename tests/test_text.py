import random

from pyspark.sql import functions as F

from pairlens.functions.text import adjacent_pairs, jaccard, sentences, token_count

SPACES = [" ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​"]
WORDS = ["a", "A", "b", "bé", "Bé", "x.y", "", "ß", "İ", "word"]


def _py_jaccard(a, b):
    sa, sb = set(a.lower().split()), set(b.lower().split())
    u = sa | sb
    return len(sa & sb) / len(u) if u else None


def test_token_count_and_jaccard_match_python(spark):
    rng = random.Random(3)

    def rnd():
        return "".join(rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.randint(0, 6)))
    rows = [(i, rnd(), rnd()) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", token_count("a").alias("n"), jaccard("a", "b").alias("j")).collect()
    for r in got:
        _, a, b = rows[r.i]
        assert r.n == len(a.split()), repr(a)
        want = _py_jaccard(a, b)
        assert (r.j is None and want is None) or abs(r.j - want) < 1e-12, (repr(a), repr(b))


def test_sentences_and_adjacent_pairs(spark):
    df = spark.createDataFrame([("One. Two.\nThree",), ("Solo.",), ("...",), ("",)], "t string")
    out = df.select(F.posexplode(adjacent_pairs(sentences("t"))).alias("k", "p")).collect()
    assert [(r.k, r.p.premise, r.p.hypothesis) for r in out] == [
        (0, "One", "Two"), (1, "Two", "Three"), (0, "Solo", ""), (0, "", ""), (0, "", "")]


def test_pairs_of_missing_text(spark):
    from pairlens.plans.fixtures import _text
    df = spark.createDataFrame([(None,)], "text string")
    out = df.select(F.posexplode(adjacent_pairs(sentences(_text()))).alias("k", "p")).collect()
    assert [(r.k, r.p.premise, r.p.hypothesis) for r in out] == [(0, "", "")]
