import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators.runs import mark_runs, mark_runs_by_range, reuse_consecutive
from pyoracle import runs


def _echo(model):
    def fn(prompts):
        return [f"<{p}>" if p is not None else None for p in prompts]
    return fn


def _rows(rng, n, gap=True):
    ords, v = [], 0
    for _ in range(n):
        v += rng.choice([1, 1, 1, 2, 7, 40]) if gap else 1
        ords.append(v)
    vals = [rng.choice(["a", "a", "b", "c", None]) for _ in range(n)]
    return ords, vals


@pytest.mark.parametrize("bits", [0, 2, 4, 16])
def test_mark_runs_matches_loop_across_buckets(spark, bits):
    rng = random.Random(bits)
    ords, vals = _rows(rng, 400)
    df = spark.createDataFrame(list(zip(ords, vals)), "o long, v string")
    marked, _ = mark_runs(df, ["o"], "v", bucket_bits=bits, block_bits=max(bits, 1))
    got = {r.o: (r.is_new, r.run_no) for r in marked.collect()}
    want = runs(vals)
    assert [got[o] for o in ords] == want


def test_mark_runs_partitioned_and_composite_order(spark):
    rng = random.Random(3)
    rows = []
    for ds in ["d1", "d2", "d3"]:
        for rid in range(0, 60, rng.choice([1, 3])):
            for k in range(rng.randint(1, 4)):
                rows.append((ds, rid, k, rng.choice(["x", "y"])))
    df = spark.createDataFrame(rows, "ds string, rid long, k long, v string")
    marked, _ = mark_runs(df, ["rid", "k"], "rid", ["ds"], bucket_bits=2)
    got = {(r.ds, r.rid, r.k): (r.is_new, r.run_no) for r in marked.collect()}
    for ds in ["d1", "d2", "d3"]:
        sub = sorted(r for r in rows if r[0] == ds)
        want = runs([r[1] for r in sub])
        assert [got[(r[0], r[1], r[2])] for r in sub] == want


def test_reuse_consecutive_calls_once_per_run(spark):
    rng = random.Random(5)
    ords, vals = _rows(rng, 300)
    df = spark.createDataFrame(list(zip(ords, vals)), "o long, v string")
    out = reuse_consecutive(df, _echo, ["o"], "v", F.col("v"), model="m", bucket_bits=3)
    got = {r.o: r.raw_answer for r in out.collect()}
    assert len(got) == len(ords)
    # the reference: every row repeats the answer of its run head
    last = None
    for o, v, (new, _) in zip(ords, vals, runs(vals)):
        if new:
            last = f"<{v}>" if v is not None else None
        assert got[o] == last


def test_mark_runs_rejects_null_order(spark):
    df = spark.createDataFrame([(None, "a")], "o long, v string")
    with pytest.raises(Exception):
        mark_runs(df, ["o"], "v")[0].collect()


def test_hot_run_spanning_many_buckets_and_blocks(spark):
    # a third of all rows in one run, crossing many buckets and blocks
    vals = ["hot"] * 1000 + [None, "x", "x", "y"] * 250 + ["hot"] * 1000
    ords = list(range(0, 2 * len(vals), 2))
    df = spark.createDataFrame(list(zip(ords, vals)), "o long, v string")
    marked, _ = mark_runs(df, ["o"], "v", bucket_bits=3, block_bits=2)
    got = {r.o: (r.is_new, r.run_no) for r in marked.collect()}
    assert [got[o] for o in ords] == runs(vals)
    out = reuse_consecutive(df, _echo, ["o"], "v", F.col("v"), model="m", bucket_bits=3)
    got = {r.o: r.raw_answer for r in out.collect()}
    assert all(got[o] == "<hot>" for o in ords[:1000] + ords[-1000:])


def test_sub_buckets_bound_the_rows_of_one_value(spark):
    # one id holds most rows; runs cross sub-buckets, ids and blocks
    rng = random.Random(8)
    rows = [(i, k, rng.choice(["x", "x", "x", "y", None])) for i in (0, 3, 4, 9, 70) for k in range(300 if i == 4 else 5)]
    df = spark.createDataFrame(rows, "o long, k long, v string")
    marked, _ = mark_runs(df, ["o", "k"], "v", bucket_bits=2, sub_bits=3, keep_bucket=True)
    assert marked.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 8
    got = {(r.o, r.k): (r.is_new, r.run_no) for r in marked.collect()}
    assert [got[r[:2]] for r in rows] == runs([r[2] for r in rows])
    out = reuse_consecutive(df, _echo, ["o", "k"], "o", F.col("v"), model="m", bucket_bits=2, sub_bits=3)
    heads = {r[0]: r[2] for r in rows if r[1] == 0}
    for r in out.collect():
        assert r.raw_answer == (None if heads[r.o] is None else f"<{heads[r.o]}>")
    with pytest.raises(Exception, match="out of range"):
        mark_runs(spark.createDataFrame([(1, -1, "a")], "o long, k long, v string"), ["o", "k"], "v", sub_bits=3)[0].collect()


@pytest.mark.parametrize("kind", ["string", "timestamp", "double", "date"])
def test_any_order_key_matches_the_loop(spark, kind):
    rng = random.Random(kind)
    rows = [(ds, f"2024-0{1 + i // 28}-{1 + i % 28:02d}", k, rng.choice(["x", "x", "y", None])) for ds in ("d1", "d2")
            for i in range(0, 50, rng.choice([1, 2])) for k in ("a", "b", "ç")]
    df = spark.createDataFrame(rows, "ds string, d string, k string, v string")
    key = {"string": F.concat(F.col("d"), F.lit("-é")), "timestamp": F.to_timestamp("d"), "date": F.to_date("d"),
           "double": F.unix_timestamp(F.to_timestamp("d")) / 7.0}[kind]
    marked = mark_runs_by_range(df.withColumn("o", key).repartition(5), ["o", "k"], "v", ["ds"], ranges=9)
    assert marked.select("_part").distinct().count() > 5
    got = {(r.ds, r.d, r.k): (r.is_new, r.run_no) for r in marked.collect()}
    for ds in ("d1", "d2"):
        sub = sorted(r for r in rows if r[0] == ds)
        assert [got[r[:3]] for r in sub] == runs([r[3] for r in sub])


def test_one_order_value_with_a_third_of_all_rows_is_split(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i:05d}", i, "same" if i % 3 == 0 else str(i // 30)) for i in range(6000)]
    df = spark.createDataFrame(rows, "o string, n long, v string")
    marked = mark_runs_by_range(df, ["o", "n"], "v", ranges=20)
    sizes = {r._part: r["count"] for r in marked.groupBy("_part").count().collect()}
    assert len(sizes) >= 15 and max(sizes.values()) < 900       # 6000 rows in 20 ranges
    assert marked.filter("o = 'hot'").select("_part").distinct().count() >= 4
    got = {r.n: (r.is_new, r.run_no) for r in marked.collect()}
    order = sorted(rows)
    assert [got[r[1]] for r in order] == runs([r[2] for r in order])
    out = reuse_consecutive(df, _echo, ["o", "n"], "v", F.col("v"), model="m").collect()
    assert len(out) == 6000 and all(r.raw_answer == f"<{r.v}>" for r in out)


def test_ranges_of_nested_values_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [i // 3, 1]) for i in range(12)], "o long, v array<long>")
    got = {r.o: r.run_no for r in mark_runs_by_range(df, ["o"], "v", ranges=3).collect()}
    assert got == {i: i // 3 + 1 for i in range(12)}
    assert mark_runs_by_range(df.limit(0), ["o"], "v").count() == 0
    with pytest.raises(Exception):
        mark_runs_by_range(spark.createDataFrame([(None, "a")], "o string, v string"), ["o"], "v").collect()
