"""Records of delimited files whose quoted fields may hold line breaks, read
by many tasks a file (SRC-4/SRC-5).

Spark's own reader gives such a file to one task, as a line break says nothing
about where a record ends. Here files are split at line breaks, wherever they
are, and a scan over the blocks finds out which of them end records:

1. A line either starts a record or is inside a quoted field. For both cases
   two expressions tell how the line would leave the reader: its *step*, a
   function of two states. A block's lines compose to one step, counted
   without reading any other block.
2. The blocks' steps, one row a block, are composed along each file: now the
   state at the start of every block is known, and where the record that is
   open there began.
3. Every block is read again from its known state. Its whole records go
   straight on to ``from_csv``; the two pieces a block may have of records
   that cross its borders are gathered by the place the record began.

The rules of quoting are those of Spark's reader with a doubled quote as the
only escape: a quote opens a field only at its start; what follows a closing
quote up to the separator belongs to the field, and quotes in it mean nothing.
Lines end with LF, or with CR LF in files whose first line does (there CR LF
is one line break everywhere, inside quotes too); lines that are empty outside
quotes are skipped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose states may be broadcast (about 200 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_BLOCKS = 100_000

# a step is two bits: 1 if the line leaves a quoted field open when it starts a record, 2 if it does when it starts inside one
_KEEP = 2
_STATES = ("file string, block bigint, step int, n0 bigint, n1 bigint, first0 boolean, crlf boolean")


def step_of(line: Column, sep: str) -> Column:
    """The step of a line. Quantifiers are possessive: no backtracking, whatever the line."""
    s = re.escape(sep)
    inside = r'[^"]*+(?:""[^"]*+)*+'                  # quoted text up to its closing quote
    rest = rf'(?:[^{s}"][^{s}]*+)?+'                  # what may follow a closing quote
    field = rf'(?:"{inside}"{rest}|[^{s}"][^{s}]*+|(?={s}))'
    opens = rf'(?:{field}{s})*+"{inside}\z'
    from_start = line.rlike(rf"\A{opens}")
    from_inside = line.rlike(rf'\A(?:{inside}\z|{inside}"{rest}{s}{opens})')
    return F.when(~F.contains(line, F.lit('"')), F.lit(_KEEP)).otherwise(
        from_start.cast("int") + 2 * from_inside.cast("int"))


def _scan(step: np.ndarray, start: int) -> np.ndarray:
    """State before every line (and behind the last) of a run of lines that begins in ``start``."""
    n = len(step)
    fixed = (step == 0) | (step == 3)
    at = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))       # the last line that sets the state
    flips = np.cumsum(step == 1)
    base = np.where(at >= 0, step[at] == 3, bool(start))
    before = np.where(at >= 0, flips[at], 0)
    after = base ^ ((flips - before) % 2 == 1)
    return np.concatenate([[bool(start)], after]).astype(np.int8)


def _runs(block: pa.Array, file: pa.Array):
    """(from, to) of the stretches of one file and block in a batch."""
    if not len(block):
        return []
    b = block.to_numpy()
    f = pc.dictionary_encode(file).indices.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((b[1:] != b[:-1]) | (f[1:] != f[:-1])) + 1
    edges = [0, *cut.tolist(), len(b)]
    return list(zip(edges, edges[1:]))


def _block_steps(batches):
    """One row a block: its step, the records that start in it for either
    state at its start, and whether its first line ends with CR."""
    held = None

    def row():
        return pa.RecordBatch.from_pylist([held], schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("step", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()),
            ("first0", pa.bool_()), ("crlf", pa.bool_())]))

    for b in batches:
        file, block, step, blank, cr = b.columns
        for lo, hi in _runs(block, file):
            key = (file[lo].as_py(), block[lo].as_py())
            if held is None or (held["file"], held["block"]) != key:
                if held is not None:
                    yield row()
                held = {"file": key[0], "block": key[1], "step": 0b10, "n0": 0, "n1": 0, "first0": False, "crlf": cr[lo].as_py()}
            s, empty = step.slice(lo, hi - lo).to_numpy(), blank.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            out = 0
            for start in (0, 1):
                at = _scan(s, held["step"] >> start & 1)
                held[f"n{start}"] += int(np.count_nonzero((at[:-1] == 0) & ~empty))
                out |= int(at[-1]) << start
            held["step"] = out
    if held is not None:
        yield row()


def _file_states(batches):
    """Compose the steps along each file (rows by file and block): state at the
    start of each block, records before it, and where the open record began."""
    file = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["file"] != file:
                file, state, n, owner, crlf = r["file"], 0, 0, -1, r["crlf"]
            starts = r["n1"] if state else r["n0"]
            end = r["step"] >> state & 1
            out.append({"file": file, "block": r["block"], "state": state, "first": n, "open": owner if state else -1,
                        "end": end, "n": starts, "crlf": crlf})
            n += starts
            if end and starts:
                owner = n - 1
            state = end
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("state", pa.int32()), ("first", pa.int64()), ("open", pa.int64()),
            ("end", pa.int32()), ("n", pa.int64()), ("crlf", pa.bool_())]))


def _records(whole: bool):
    """Rows (file, nr, block, text): the whole records of each block, or only
    its pieces of records that cross its borders. ``nr`` counts a file's records."""
    schema = pa.schema([("file", pa.string()), ("nr", pa.int64()), ("block", pa.int64()), ("text", pa.string())])

    def run(batches):
        held = None     # of the block being read: file, block, state now, number of the record at hand, its lines so far

        def close(last: bool):
            """The piece at the end of a block."""
            if held["lines"] and (whole != (held["crossing"] or last)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                    (held["key"][0], held["nr"], held["key"][1], "\n".join(held["lines"])), schema.types)], schema=schema)

        for b in batches:
            file, block, line, step, blank, state, first, opened, end = b.columns
            for lo, hi in _runs(block, file):
                key = (file[lo].as_py(), block[lo].as_py())
                if held is None or held["key"] != key:
                    if held is not None:
                        yield from close(held["end"] == 1)
                    inside = state[lo].as_py()
                    held = {"key": key, "state": inside, "next": first[lo].as_py(), "nr": opened[lo].as_py(), "lines": [],
                            "crossing": bool(inside), "end": end[lo].as_py()}
                s, empty = step.slice(lo, hi - lo).to_numpy(), blank.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                text = line.slice(lo, hi - lo)
                at = _scan(s, held["state"])
                begins = np.flatnonzero((at[:-1] == 0))
                head = int(begins[0]) if len(begins) else hi - lo
                held["lines"] += text.slice(0, head).to_pylist()
                held["state"] = int(at[-1])
                if not len(begins):
                    continue
                yield from close(False)
                stop = np.append(begins[1:], hi - lo)
                keep = ~(empty[begins] & (stop - begins == 1))
                begins, stop = begins[keep], stop[keep]
                held["lines"] = []
                if not len(begins):
                    continue
                # all but the last are whole; the last may go on in the next batch or block
                if whole and len(begins) > 1:
                    lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stop[:-1] - begins[:-1])), pa.int32()),
                                                     _take(text, begins[:-1], stop[:-1]))
                    n = len(begins) - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key[0]] * n, pa.string()), pa.array(held["next"] + np.arange(n), pa.int64()),
                        pa.array(np.full(n, key[1]), pa.int64()), pc.binary_join(lines, "\n")], schema=schema)
                held["nr"] = held["next"] + len(begins) - 1
                held["next"] += len(begins)
                held["lines"] = text.slice(int(begins[-1]), int(stop[-1] - begins[-1])).to_pylist()
                held["crossing"] = False
        if held is not None:
            yield from close(held["end"] == 1)

    return run


def _take(text: pa.Array, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The lines of all stretches behind each other."""
    n = stop - begin
    return text.take(pa.array(np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))))


def split_records(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, DataFrame]:
    """(records, files): every record of the files at ``path`` as a row (file,
    nr, text), ``nr`` from 0 in file order, and the records of each file (file, n)."""
    from ..session import materialize
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.withColumn("step", step_of(F.col("value"), sep)).withColumn("blank", F.col("value").isin("", "\r"))
    steps = lines.select("file", "block", "step", "blank", F.endswith("value", F.lit("\r")).alias("cr")).mapInArrow(
        _block_steps, _STATES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states = materialize(steps.repartition(parts, "file").sortWithinPartitions("file", "block").mapInArrow(
        _file_states, "file string, block bigint, state int, first bigint, open bigint, end int, n bigint, crlf boolean"), "blocks")
    counts = states.agg(F.count(F.lit(1)), F.count_if(F.expr("state = 1 OR end = 1"))).first()
    if counts[0] <= MAX_BROADCAST_BLOCKS:
        placed = lines.join(F.broadcast(states.drop("n", "crlf")), ["file", "block"])
    else:       # one task must still read a block from its first line to its last
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(states.drop("n", "crlf"), ["file", "block"]) \
            .sortWithinPartitions("file", "block", "place")
    cols = ["file", "block", "value", "step", "blank", "state", "first", "open", "end"]
    schema = "file string, nr bigint, block bigint, text string"
    records = placed.select(*cols).mapInArrow(_records(True), schema).drop("block")
    if counts[1]:
        pieces = placed.filter("state = 1 OR end = 1").select(*cols).mapInArrow(_records(False), schema)
        joined = pieces.groupBy("file", "nr").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")) \
            .select("file", "nr", F.array_join(F.col("p.text"), "\n").alias("text"))
        records = records.unionByName(materialize(joined, "crossing"))
    files = states.groupBy("file").agg(F.sum("n").alias("n"), F.bool_or("crlf").alias("crlf"))
    # a file's line ends: CR LF if its first line ends so
    crlf = files.filter("crlf").select("file", F.lit(True).alias("crlf"))
    if not crlf.isEmpty():
        records = records.join(crlf, "file", "left").withColumn(
            "text", F.when(F.col("crlf"), F.regexp_replace("text", r"\r(?=\n|\z)", "")).otherwise(F.col("text"))).drop("crlf")
    return records, files.select("file", "n")


def read_split(spark: SparkSession, path: str, schema, sep: str, header: bool, options: dict,
               order_col: str | None = None, file_col: str | None = None) -> DataFrame:
    """Rows of delimited files with the columns of ``schema`` (in the files'
    order). With ``header`` every file's first record must name them.
    ``file_col`` adds the file a row comes from, ``order_col`` the row's number in file order, from 0 and gapless."""
    records, files = split_records(spark, path, sep)
    options = {**options, "sep": sep, "multiLine": "true"}
    if header:
        names = F.array(*map(F.lit, schema.names))
        text = ", ".join(f"c{i} string" for i in range(len(schema.names)))
        found = F.from_csv(F.col("text"), text, {**options, "mode": "PERMISSIVE"})
        got = F.array(*[found[f"c{i}"] for i in range(len(schema.names))])
        wrong = F.raise_error(F.concat(F.col("file"), F.lit(": another header: "), F.col("text"))).cast("boolean")
        records = records.filter(F.when(F.col("nr") > 0, True).when(F.coalesce(got == names, F.lit(False)), False).otherwise(wrong))
    # the parser's columns are all read, so that a broken record fails whatever the query needs
    row = F.from_csv(F.col("text"), _ddl(schema), {**options, "mode": "FAILFAST"})
    keep = [F.col("file").alias(file_col)] if file_col else []
    if order_col is None:
        return records.select(row.alias("r"), *keep).select("r.*", *([file_col] if file_col else []))
    skip = 1 if header else 0
    # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", (F.coalesce(F.sum(F.col("n") - skip).over(before), F.lit(0)) - skip).alias("off"))
    if files.count() <= MAX_BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return (records.join(offsets, "file").select(row.alias("r"), *keep, (F.col("nr") + F.col("off")).alias(order_col))
            .select("r.*", *([file_col] if file_col else []), order_col))


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
