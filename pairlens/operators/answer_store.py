"""GEN-1 answer store: answers by model and prompt digest, in buckets.

Layout::

    <path>/model=<model>/bucket=<0 .. BUCKETS-1>/part-*.parquet
        digest binary   sha256 of the prompt as sent
        answer string
        at     bigint   time of the write (the earliest answer counts)
    <path>/model=r-<list>/bucket=<0 .. BUCKETS-1>/part-*.parquet
        digest  binary          the first half of a sentence pair's sha256
        answers array<string>   its answers by the runs of a list
        places  array<int>      their places in the list; NULL: all, in order
        at      bigint
    <path>/_runs/part-*.parquet
        list string, place int, model string (folder), template string

An evaluation asks a list of runs (model, template of the prompt) of each pair:
the list is named once, under ``_runs``, and a pair's answers are one row.
A run whose model and template no list names has no answer here; its lookup
reads ``_runs`` and nothing else.

An answer belongs to the model and to the prompt as sent, nothing else: an
other prefix or layout is another digest, or another template. A lookup joins on the first half
of the digest; sentences never travel for it. What it reads is cut three times by
the current requests: their models and buckets prune folders, and their
hashes, where they are few enough for a bounded broadcast, keep other rows
of a bucket out of the shuffle.

Two writers that run side by side may store an answer to one request each and
go on with their own; every later reader takes the earliest.
"""

from __future__ import annotations

import hashlib
import json
import time
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a model; part of the layout, the same for all who share a store.
BUCKETS = 64
#: Values of the hash that filters a bucket's rows; a list of them (at most 8 MB) is broadcast.
SLOTS = 1 << 20
#: Distinct models that are listed for pruning; with more, all models' folders are read.
MAX_MODELS = 1000
#: Where the lists of runs are named; Spark skips such a folder when it reads the store's.
LISTS = "/_runs"
#: In packed answers: what parts them, and a missing one; how answers write these characters and the first of the codes.
_NEXT, _MISSING = "\u0001", "\u0002"
_MARKS = [("\u0003", "\u00033"), (_NEXT, "\u00031"), (_MISSING, "\u00032")]

SCHEMA = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("answer", T.StringType()),
    T.StructField("at", T.LongType()), T.StructField("model", T.StringType()),
    T.StructField("bucket", T.IntegerType())])
PAIR_SCHEMA = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("places", T.ArrayType(T.IntegerType())), *SCHEMA.fields[2:]])
LIST_SCHEMA = T.StructType([
    T.StructField("list", T.StringType()), T.StructField("place", T.IntegerType()),
    T.StructField("model", T.StringType()), T.StructField("template", T.StringType())])


def digest_of(text: Column) -> Column:
    """Fixed-width digest of a text (NULL for NULL)."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def short_digest(text: Column) -> Column:
    """A key of at most 16 bytes to join rows by within a run: a text of fewer
    bytes itself, else 128 bits of its sha256 (of a thousand million texts two
    share one with a chance of 1 to 10^20)."""
    return F.when(F.octet_length(text) < 16, text.cast("binary")).otherwise(F.substring(digest_of(text), 1, 16))


def prompt_digest(prompt: Column, kind: T.DataType) -> Column:
    """Digest of a prompt as sent; chat messages count as their JSON."""
    return digest_of(prompt if isinstance(kind, T.StringType) else F.to_json(prompt))


def pack_answers(answers: Column) -> Column:
    """An array of answers as one text, to be shuffled: an array takes 16 bytes
    an element besides its texts. :func:`unpack_answers` gives the array back."""
    def marked(a):
        for mark, code in _MARKS:
            a = F.replace(a, F.lit(mark), F.lit(code))
        return F.coalesce(a, F.lit(_MISSING))
    return F.when(answers.isNotNull(), F.array_join(F.transform(answers, marked), _NEXT))


def unpack_answers(packed: Column) -> Column:
    """The array of :func:`pack_answers` (of one answer or more)."""
    def plain(a):
        out = a
        for mark, code in reversed(_MARKS):
            out = F.replace(out, F.lit(code), F.lit(mark))
        return F.when(a != F.lit(_MISSING), out)
    return F.transform(F.split(packed, _NEXT), plain)


def folder_of(model: Column) -> Column:
    """A model's folder name: a missing and an empty name have one, too."""
    return F.coalesce(F.concat(F.lit("m-"), model), F.lit("none"))


def _folder(model: str | None) -> str:
    return "none" if model is None else f"m-{model}"


def _half(digest: Column) -> Column:
    """What lookups join on; a digest's half is as good as the digest (:func:`short_digest`)."""
    return F.substring(digest, 1, 16)


def _slot(digest: Column) -> Column:
    return F.pmod(F.xxhash64(_half(digest)), F.lit(SLOTS)).cast("int")


def _bucket(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") % F.lit(BUCKETS)


class AnswerStore:
    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self, schema: T.StructType = SCHEMA, folder: str = "") -> DataFrame | None:
        """The whole store; None where nothing is stored yet."""
        from ..sources.readers import missing_path
        try:
            return self.spark.read.schema(schema).parquet(self.path + folder)
        except Exception as exc:
            if missing_path(exc):
                return None
            raise

    def relevant(self, asked: DataFrame, n: int, models: list | None = None) -> DataFrame | None:
        """Rows of the store that ``asked`` (model, digest; ``n`` rows) may
        need: its models' and buckets' folders, and of those the rows of its
        hashes. ``models``: the models of ``asked``, where the caller knows them."""
        rows = self.rows()
        if rows is None:
            return None
        # what comes to the driver is bounded: the buckets, and a thousand model names
        if models is None:
            models = [r.model for r in asked.select("model").distinct().limit(MAX_MODELS + 1).collect()]
        if len(models) <= MAX_MODELS:
            rows = rows.filter(F.col("model").isin([_folder(m) for m in models]))
        return self._near(rows, asked, n)

    def _near(self, rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        """Of ``rows`` those in the buckets and of the hashes of ``asked``."""
        if n <= SLOTS // 2:
            buckets = [r.b for r in asked.select(_bucket(F.col("digest")).alias("b")).distinct().collect()]
            if len(buckets) < BUCKETS:
                rows = rows.filter(F.col("bucket").isin(sorted(buckets)))
            slots = asked.select(_slot(F.col("digest")).alias("slot")).distinct()
            rows = rows.withColumn("slot", _slot(F.col("digest"))).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
        return rows

    def look_up(self, asked: DataFrame, n: int, answer_col: str, models: list | None = None,
                unknown: bool = True) -> DataFrame | None:
        """``asked`` (``n`` rows; its digests may be first halves) with the
        earliest stored answer of each row's request and whether there is one
        (``known``), or with ``unknown=False`` only the rows that have one;
        None without a store."""
        from ..session import materialize
        rows = self.relevant(asked, n, models)
        if rows is None:
            return None
        rows = rows.select(F.col("model").alias("_folder"), _half(F.col("digest")).alias("_half"), "at",
                           F.col("answer").alias(answer_col), F.lit(True).alias("known"))
        mine = asked.withColumn("_folder", folder_of(F.col("model"))).withColumn("_half", _half(F.col("digest")))
        got = materialize(mine.join(rows, ["_folder", "_half"], "left" if unknown else "inner")
                          .drop("_folder", "_half").withColumn("known", F.coalesce("known", F.lit(False))), "looked-up")
        if not unknown or got.count() > n:      # two writers stored an answer to one request
            got = got.groupBy(*asked.columns, "known").agg(F.min_by(answer_col, F.struct("at", answer_col)).alias(answer_col))
        return got.select(*asked.columns, answer_col, "known")

    def add(self, answers: DataFrame, answer_col: str) -> None:
        """Append answers (model, digest, ``answer_col``), few files a folder."""
        out = answers.select("digest", F.col(answer_col).alias("answer"),
                             folder_of(F.col("model")).alias("model"), _bucket(F.col("digest")).alias("bucket"))
        out = out.hint("rebalance", "model", "bucket").withColumn("at", F.lit(time.time_ns()))
        out.write.mode("append").partitionBy("model", "bucket").parquet(self.path)

    def lists_with(self, runs: list[tuple]) -> dict[str, list]:
        """The stored lists that name some of ``runs`` (model, template): for
        each place of a list the number of its run in ``runs``, or None."""
        named = self.rows(LIST_SCHEMA, LISTS)
        if named is None:
            return {}
        number = {(_folder(m), t): i for i, (m, t) in enumerate(runs)}
        # what comes to the driver is bounded: the runs of lists with a template that is asked for
        some = named.join(named.filter(F.col("template").isin([t for _, t in runs])).select("list").distinct(), "list", "left_semi")
        found: dict[str, dict] = {}
        for r in some.collect():
            found.setdefault(r.list, {})[r.place] = number.get((r.model, r.template))
        places = {name: [at[i] for i in range(len(at))] for name, at in found.items()}
        return {name: at for name, at in places.items() if any(i is not None for i in at)}

    def look_up_runs(self, pairs: DataFrame, n: int, lists: dict[str, list], pair_col: str) -> DataFrame:
        """The pairs (``pair_col``: halves of their digests, distinct; ``n``)
        that have answers under ``lists``, with ``by_run``: the earliest answer
        of each run that has one."""
        from ..session import materialize
        asked = pairs.select(F.col(pair_col).alias("digest"))
        rows = self.rows(PAIR_SCHEMA).filter(F.col("model").isin(sorted(lists)))
        numbers = F.create_map(*[x for name, at in lists.items()
                                 for x in (F.lit(name), F.array(*[F.lit(i).cast("int") for i in at]))])[F.col("model")]
        places = F.coalesce("places", F.sequence(F.lit(0), F.size("answers") - 1))
        answered = F.zip_with(places, "answers", lambda p, a: F.struct(F.get(numbers, p).alias("run"), a.alias("answer")))
        rows = self._near(rows, asked, n).select("digest", F.struct("at", F.filter(answered, lambda x: x["run"].isNotNull()).alias("answered")).alias("row"))
        # lists may share runs, and two writers may have stored one pair: in the order of their writes
        got = asked.join(rows, "digest").groupBy("digest").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        got = got.select("digest", F.flatten("rows.answered").alias("all"))
        first = F.transform(F.array_distinct("all.run"), lambda r: F.struct(
            r.alias("run"), F.get(F.filter("all", lambda x: x["run"] == r), F.lit(0))["answer"].alias("answer")))
        return materialize(got.select(F.col("digest").alias(pair_col), F.map_from_entries(first).alias("by_run")), "looked-up")

    def add_runs(self, answers: DataFrame, runs: list[tuple], pair_col: str, answers_col: str,
                 places_col: str | None = None) -> None:
        """Append the pairs' answers by the list ``runs`` (model, template):
        all of it, or the places ``places_col``. The list is named first."""
        named = [(_folder(m), t) for m, t in runs]
        name = "r-" + hashlib.sha256(json.dumps(named).encode()).hexdigest()[:32]
        if name not in self.lists_with(runs):
            lines = [(name, i, m, t) for i, (m, t) in enumerate(named)]
            self.spark.createDataFrame(lines, LIST_SCHEMA).coalesce(1).write.mode("append").parquet(self.path + LISTS)
        out = answers.select(F.col(pair_col).alias("digest"), pack_answers(F.col(answers_col)).alias("answers"),
                             *([F.col(places_col).alias("places")] if places_col else []), _bucket(F.col(pair_col)).alias("bucket"))
        out = (out.hint("rebalance", "bucket").withColumn("answers", unpack_answers(F.col("answers")))
               .withColumn("at", F.lit(time.time_ns())).withColumn("model", F.lit(name)))
        out.write.mode("append").option("compression", "zstd").partitionBy("model", "bucket").parquet(self.path)

    def has_single(self, models: list) -> bool:
        """Whether answers by prompt are stored for one of ``models``."""
        rows = self.rows()
        return rows is not None and not rows.filter(F.col("model").isin([_folder(m) for m in models])).isEmpty()

    def known(self, asked: DataFrame, n: int, answer_col: str, models: list | None = None) -> tuple[DataFrame | None, int]:
        """The rows of ``asked`` (``n``) that have a stored answer, with it, and their number."""
        found = self.look_up(asked, n, answer_col, models, unknown=False)
        return (None, 0) if found is None else (found.select(*asked.columns, answer_col), found.count())


def without(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``asked`` that ``known`` (rows of it) lacks."""
    name = [folder_of(F.col("model")).alias("_folder"), _half(F.col("digest")).alias("_half")]
    return asked.select("*", *name).join(known.select(*name), ["_folder", "_half"], "left_anti").select(*asked.columns)


def answer_stored(asked: DataFrame, store: AnswerStore, ask: Callable[[DataFrame | None], DataFrame],
                  answer_col: str = "raw_answer", n: int | None = None, models: list | None = None) -> DataFrame:
    """``asked`` (model, digest and the caller's keys; distinct, no texts) with
    answers: stored ones are looked up, the rest is asked for once, written
    down and stored. ``ask(missing)`` answers the requests of ``missing``,
    rows of ``asked``, or all of them if that is None: the same columns and
    ``answer_col``. ``n``, ``models``: rows and models of ``asked``, if known."""
    from ..session import materialize

    def answer_new(missing: DataFrame | None) -> DataFrame:
        new = materialize(ask(missing).select(*asked.columns, answer_col), "answered")
        store.add(new, answer_col)
        return new

    if store.rows() is None:
        return answer_new(None)
    if n is None:
        asked = materialize(asked, "asked")
        n = asked.count()
    known, n_known = store.known(asked, n, answer_col, models)
    if n_known == n:
        return known
    if not n_known:
        return answer_new(None)
    return known.unionByName(answer_new(without(asked, known)))
