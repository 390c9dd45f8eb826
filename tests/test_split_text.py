"""Split reading of quoted text with line breaks against Spark's one-task reader."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from pairlens.sources import readers as R
from pairlens.sources import split_text as S

SCHEMA = "premise string, hypothesis string, note string"
BLOCK = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def tiny_blocks(spark):
    old = {k: spark.conf.get(k) for k in BLOCK}
    for k, v in BLOCK.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def one_task(spark, path, sep, header=True):
    """What Spark's own reader gives, a file to a task."""
    return sorted(map(repr, (tuple(r) for r in spark.read.schema(SCHEMA).option("sep", sep).option("header", header)
                             .option("quote", '"').option("escape", '"').option("nullValue", R.NULL_MARKER)
                             .option("multiLine", True).option("mode", "FAILFAST").csv(path).collect())))


def split(spark, path, sep, header=True):
    return sorted(map(repr, (tuple(r) for r in R._delimited(spark, path, SCHEMA, sep, header).collect())))


def field(rnd, sep):
    body = "".join(rnd.choice(['a', 'é', ' ', '"', '""', '\n', '\n\n', sep, '漢', "'", 'word']) for _ in range(rnd.choice([0, 1, 3, 12, 60])))
    kind = rnd.random()
    if kind < 0.5:
        return '"' + body.replace('"', '""') + '"'
    plain = body.replace("\n", " ").replace(sep, " ").replace('"', "'")
    if kind < 0.6:
        return "z" + plain + 'a 5" nail"'[rnd.randrange(10):]      # quotes that open nothing
    return plain


def write(path, rnd, sep, n, end="\n", header=True):
    with open(path, "w", encoding="utf-8", newline="") as f:
        if header:
            f.write(sep.join(["premise", '"hypothesis"', "note"]) + end)
        for _ in range(n):
            row = [field(rnd, sep).replace("\n", end) for _ in range(3)]
            if row[0][:1] != '"':
                row[0] = "x" + row[0]         # an unquoted blank line would be skipped by both
            f.write(sep.join(row) + end + (end if rnd.random() < 0.1 else ""))


@pytest.mark.parametrize("sep,end", [("\t", "\n"), (",", "\n"), ("\t", "\r\n")])
def test_rows_are_those_of_one_task(spark, tmp_dir, tiny_blocks, sep, end):
    rnd = random.Random(f"{sep}{end}")
    for k in range(2):
        os.makedirs(f"{tmp_dir}/{k}")
        for i in range(2):
            write(f"{tmp_dir}/{k}/p{i}.tsv", rnd, sep, rnd.choice([1, 60]), end)
        assert split(spark, f"{tmp_dir}/{k}", sep) == one_task(spark, f"{tmp_dir}/{k}", sep)
    write(f"{tmp_dir}/bare.tsv", rnd, sep, 30, end, header=False)
    assert split(spark, f"{tmp_dir}/bare.tsv", sep, False) == one_task(spark, f"{tmp_dir}/bare.tsv", sep, False)


def test_malformed_quotes_end_records_where_spark_ends_them(spark, tmp_dir, tiny_blocks):
    path = f"{tmp_dir}/odd.tsv"
    with open(path, "w") as f:
        f.write('premise\thypothesis\tnote\n"ab"cd"\t"x\ny"z\tq\n"one"\t"two ""\nthree"\t"four"\n'
                'a"b\t""\t"""\n"""\n\n"' + "long\n" * 200 + '"\tb\tc\nlast\tline\t"is ""open\nto the end')
    assert split(spark, path, "\t") == one_task(spark, path, "\t")


def test_one_file_is_read_by_many_tasks_in_order(spark, tmp_dir, tiny_blocks):
    rnd = random.Random(9)
    rows = [(str(i), "line\n" * rnd.randrange(5) + 'q "', None if i % 3 == 0 else "") for i in range(700)]
    for name, part in (("a", rows[:500]), ("b", rows[500:])):
        with open(f"{tmp_dir}/{name}.tsv", "w", newline="") as f:
            f.write("premise\thypothesis\tnote\n")
            for a, b, c in part:
                f.write(f'{a}\t"{b.replace(chr(34), chr(34) * 2)}"\t{"" if c is None else chr(34) * 2}\n')
    df = R.load_dataset(spark, tmp_dir, SCHEMA, "tsv", order_col="nr")
    got = df.orderBy("nr").collect()
    assert [tuple(r)[:3] for r in got] == rows and [r.nr for r in got] == list(range(700))
    lines = spark.read.option("lineSep", "\n").text(tmp_dir)
    assert lines.rdd.getNumPartitions() > 20
    records, _ = S.split_records(spark, tmp_dir, "\t")
    whole = records.filter("nr > 0").withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert whole > 20
    # numbers don't depend on what a branch reads
    both = df.select("nr", "premise").join(R.load_dataset(spark, tmp_dir, SCHEMA, "tsv", order_col="nr").select("nr", "note"), "nr")
    assert both.filter("premise <> nr").count() == 0 and both.count() == 700


def test_many_blocks_are_joined_by_shuffle(spark, tmp_dir, tiny_blocks, monkeypatch):
    write(f"{tmp_dir}/a.tsv", random.Random(4), "\t", 60)
    want = split(spark, f"{tmp_dir}/a.tsv", "\t")
    monkeypatch.setattr(S, "MAX_BROADCAST_BLOCKS", 0)
    assert split(spark, f"{tmp_dir}/a.tsv", "\t") == want == one_task(spark, f"{tmp_dir}/a.tsv", "\t")


def test_another_header_and_broken_records_fail(spark, tmp_dir):
    for name, text in (("a", "premise\thypothesis\tnote\n1\t2\t3\n"), ("b", "premise\tnote\thypothesis\n1\t2\t3\n")):
        with open(f"{tmp_dir}/{name}.tsv", "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="another header"):
        R.load_dataset(spark, tmp_dir, SCHEMA, "tsv").collect()
    with open(f"{tmp_dir}/b.tsv", "w") as f:
        f.write("premise\thypothesis\tnote\n1\t2\t3\tfour\n")
    with pytest.raises(Exception):
        R.load_dataset(spark, tmp_dir, SCHEMA, "tsv").select("premise").collect()


def test_python_s_reader_agrees(spark, tmp_dir, tiny_blocks):
    rnd = random.Random(2)
    rows = [[("".join(rnd.choice(['"', "\n", "\t", "a", "é"]) for _ in range(rnd.randrange(30)))) or "-" for _ in range(3)] for _ in range(200)]
    with open(f"{tmp_dir}/p.tsv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter="\t", quoting=csv.QUOTE_ALL, lineterminator="\n")
        w.writerow(["premise", "hypothesis", "note"])
        w.writerows(rows)
    got = R.load_dataset(spark, f"{tmp_dir}/p.tsv", SCHEMA, order_col="nr").orderBy("nr").collect()
    assert [list(r)[:3] for r in got] == rows
