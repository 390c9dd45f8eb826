"""Readers for pair datasets (SRC-1 .. SRC-6, SRC-8).

Every reader takes an explicit schema (no inference pass over the data).
Text files keep the reference's quoting rules: a doubled quote inside a
quoted field is one quote (``escape='"'``). Words such as ``None``, ``NA``
or ``null`` stay text -- they are legitimate sentences -- and only empty
fields are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split_text import read_split

FORMATS = ("json", "jsonl", "tsv", "csv")
NULL_MARKER = "\u0000"


def missing_path(exc: Exception) -> bool:
    """Whether a read failed because there is nothing at the path yet; any other failure is one."""
    from pyspark.errors import AnalysisException
    return isinstance(exc, AnalysisException) and exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def format_of(path: str, fmt: str | None = None) -> str:
    """SRC-1: reader chosen by the last suffix: json, jsonl, tsv, else csv.
    An unknown suffix is an error unless a format is given (the reference
    silently fell back to comma-separated text)."""
    if fmt:
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}")
        return fmt
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix in FORMATS:
        return suffix
    raise ValueError(f"cannot tell the format of {path!r} from its suffix; pass fmt=")


def read_json_records(spark: SparkSession, path: str, schema, order_col: str | None = None) -> DataFrame:
    """SRC-2: JSON documents in either layout that data frames are written in:
    a list of records, or columns (``{"premise": {"0": ...}, ...}``: row key to
    value; also plain lists of values). Files of both layouts may lie in one
    folder, and each is read once: every wanted field is parsed as a variant,
    whose type tells a value from a whole column.

    A document is one of columns if all its wanted fields of atomic type hold
    objects or lists (in a list of records those would be of the wrong type).
    Its columns are zipped by key; a row has every key that some wanted column
    has, and is NULL in the others, as a record is for a key it lacks. Rows
    whose keys number them from 0 come in that order, others by key as text."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = T.StructType([T.StructField(f.name, T.VariantType()) for f in want.fields])
    docs = spark.read.schema(raw).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nested = (T.StructType, T.MapType, T.ArrayType)
    cell = {f.name: f"`{f.name}`" for f in want.fields}
    by_key = "try_variant_get({0}, '$', 'map<string,variant>')"
    by_place = "map_from_entries(transform(try_variant_get({0}, '$', 'array<variant>'), (x, i) -> struct(cast(i AS string), x)))"
    column = {n: f"coalesce({by_key.format(c)}, {by_place.format(c)})" for n, c in cell.items()}
    tested = [f.name for f in want.fields if not isinstance(f.dataType, nested)]
    missing = {n: f"({cell[n]} IS NULL OR is_variant_null({cell[n]}))" for n in tested}
    is_columns = " AND ".join([f"({missing[n]} OR {column[n]} IS NOT NULL)" for n in tested]
                              + ["(" + " OR ".join(f"NOT {missing[n]}" for n in tested) + ")"]) if tested else "false"
    # key -> the row's cells, one column after the other
    names = want.names
    rows = f"transform_values(coalesce({column[names[0]]}, map()), (k, v) -> struct(v AS c0))"
    for i, n in enumerate(names[1:], 1):
        cells = ", ".join(f"r.c{j} AS c{j}" for j in range(i))
        rows = f"map_zip_with({rows}, coalesce({column[n]}, map()), (k, r, v) -> struct({cells}, v AS c{i}))"
    numbers = "transform(map_keys(_rows), k -> try_cast(k AS bigint))"
    numbered = (f"array_min({numbers}) = 0 AND array_max({numbers}) = cardinality(_rows) - 1 "
                f"AND NOT exists({numbers}, k -> k IS NULL)")
    record = "struct(" + ", ".join(f"{cell[n]} AS c{i}" for i, n in enumerate(names)) + ")"
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    split = placed.withColumn("_rows", F.expr(f"CASE WHEN {is_columns} THEN {rows} END")).withColumn(
        "_numbered", F.expr(numbered))
    one = F.expr(f"array(struct(cast(null AS string) AS key, {record} AS value))")
    out = split.select("_file", "_block", "_numbered", F.posexplode(F.coalesce(F.map_entries("_rows"), one)).alias("_i", "_e"))
    values = [F.expr(f"variant_get(_e.value.c{i}, '$', '{f.dataType.simpleString()}')").alias(f.name) for i, f in enumerate(want.fields)]
    if order_col is None:
        return out.select(*values)
    nr = F.when(F.col("_numbered"), F.col("_e.key").cast("bigint")).when(F.col("_numbered").isNotNull(), F.col("_i"))
    return with_row_order(out.select(*values, "_file", "_block", nr.cast("bigint").alias("_nr")), order_col)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC-3: JSON Lines (splittable)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _bound_by_name(reader, path: str, schema) -> tuple[T.StructType, list[str]]:
    """The schema in the order of the file's header, and the wanted columns.
    Columns the schema doesn't name are read as text and left out after."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = reader.csv(path).columns
    if not names:       # nothing to read
        return want, want.names
    missing = [n for n in want.names if n not in names]
    if missing:
        raise KeyError(f"{path}: columns {missing} not found in {names}")
    return T.StructType([want[n] if n in want.names else T.StructField(n, T.StringType()) for n in names]), want.names


def _delimited(spark: SparkSession, path: str, schema, sep: str, header: bool,
               multiline: bool = True, order_col: str | None = None) -> DataFrame:
    """Columns are bound by header name, whatever their order; every file of
    a folder must have the same header. Files are split either way: with
    ``multiline`` after a scan for the records' borders (:mod:`.split_text`)."""
    # an unquoted empty field is NULL, a quoted one ("") the empty string: the comparison marker must differ from ""
    options = {"quote": '"', "escape": '"', "nullValue": NULL_MARKER}
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wanted = want.names
    if header:
        first = spark.read.options(**options).option("sep", sep).option("header", True).option("multiLine", multiline)
        want, wanted = _bound_by_name(first, path, want)
    if multiline:
        df = read_split(spark, path, want, sep, header, options, order_col)
    else:
        df = (spark.read.schema(want).options(**options).option("enforceSchema", False)
              .option("sep", sep).option("header", header).option("multiLine", False).option("mode", "FAILFAST").csv(path))
        if order_col:
            df = with_row_order(df, order_col)
    keep = [*wanted, *([order_col] if order_col else [])]
    return df if df.columns == keep else df.select(*keep)


def read_tsv(spark: SparkSession, path: str, schema, header: bool = True,
             multiline: bool = True, order_col: str | None = None) -> DataFrame:
    """SRC-4 (header) / SRC-6 (no header: names come from the schema).
    ``multiline=False`` spares the scan for record borders when no field holds
    a line break. ``order_col`` adds the row's number in file order."""
    return _delimited(spark, path, schema, "\t", header, multiline, order_col)


def read_csv(spark: SparkSession, path: str, schema, header: bool = True,
             multiline: bool = True, order_col: str | None = None) -> DataFrame:
    """SRC-5: comma-separated with header."""
    return _delimited(spark, path, schema, ",", header, multiline, order_col)


def load_dataset(spark: SparkSession, path: str, schema, fmt: str | None = None,
                 language: str | None = None, language_col: str = "language",
                 multiline: bool = True, order_col: str | None = None) -> DataFrame:
    """SRC-1 (+ FLT-1): read by suffix, optionally keep one language.
    ``multiline=False``: no field of a delimited file holds a line break.
    ``order_col`` adds the row's number in file order (before the filter)."""
    kind = format_of(path, fmt)
    if kind == "json":
        df = read_json_records(spark, path, schema, order_col)
    elif kind == "jsonl":
        df = read_json_lines(spark, path, schema)
        if order_col:
            df = with_row_order(df, order_col)
    else:
        df = _delimited(spark, path, schema, "\t" if kind == "tsv" else ",", True, multiline, order_col)
    if language is not None:
        if language_col not in df.columns:
            raise KeyError(f"language filter on a table without column {language_col!r}")
        df = df.filter(F.col(language_col) == F.lit(language))
    return df


#: Blocks (file splits) whose offsets may be broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST_BLOCKS = 100_000


def with_row_order(df: DataFrame, col: str = "row_ord") -> DataFrame:
    """File order as a gapless long from 0: the same for every read of the
    same files, and for every branch of a query, however it is pruned.

    A block (file, start) is read by one task from its first row to its last,
    so a row's number is its place in the block plus the rows of all blocks
    before. Only one row per block is aggregated and summed; data rows are
    neither sorted nor shuffled."""
    if "_file" in df.columns:       # a reader's own note of where a row comes from, and of its place in a document
        placed = df.withColumn("_pos", F.monotonically_increasing_id())
    else:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                           F.lit(None).cast("bigint").alias("_nr"), F.monotonically_increasing_id().alias("_pos"))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_pos").alias("_at"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_at", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_at")).alias("_off"))
    if blocks.count() <= MAX_BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    place = F.coalesce(F.col("_at") + F.col("_nr"), F.col("_pos"))
    return (placed.join(blocks, ["_file", "_block"]).withColumn(col, place + F.col("_off"))
            .drop("_file", "_block", "_pos", "_off", "_at", "_nr"))


def read_versions(spark: SparkSession, original: DataFrame | None, paraphrase: DataFrame | None) -> DataFrame:
    """SRC-8: both text versions in one table with a ``text_version`` column;
    choosing one is a filter on that column."""
    parts = []
    if original is not None:
        parts.append(original.withColumn("text_version", F.lit("original")))
    if paraphrase is not None:
        parts.append(paraphrase.withColumn("text_version", F.lit("paraphrase")))
    if not parts:
        raise ValueError("no input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
