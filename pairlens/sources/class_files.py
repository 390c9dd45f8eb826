"""PRE-2 from files: the class of a row is that of the file it comes from.

All class files are read in one scan; a row's file, noted by the scan, is
looked up in the map from files to labels. The plan doesn't grow with the
number of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import NULL_MARKER
from .split_text import read_split


def _plain(path) -> "F.Column":
    """A scan's file path as the file system spells it: no percent codes (a
    plus sign is none), one slash behind the scheme where there is no host."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^([a-zA-Z0-9]+):/+(?=/)", "$1:")


def read_class_files(spark: SparkSession, files: dict[str, str | list[str]], schema, sep: str = "\t",
                     label_col: str = "label") -> DataFrame:
    """Rows of headerless delimited files with ``label_col``: ``files`` maps a
    label to its file or folder, or a list of them (as many rows as the driver
    listed paths). Duplicate rows are kept; a file under no label is an error."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    named = [(p, label) for label, paths in files.items() for p in ([paths] if isinstance(paths, str) else paths)]
    conf = spark._jsc.hadoopConfiguration()
    paths, spelled = [p for p, _ in named], []
    for p, label in named:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        spelled.append((where.getFileSystem(conf).makeQualified(where).toString(), label))
    if len({s for s, _ in spelled}) < len(spelled):
        raise ValueError("one path has two labels, or one twice")
    labels = spark.createDataFrame(spelled, "path string, label string").withColumn(
        "path", F.regexp_replace("path", "^([a-zA-Z0-9]+):/+(?=/)", "$1:"))
    options = {"quote": '"', "escape": '"', "nullValue": NULL_MARKER}
    rows = read_split(spark, paths, want, sep, False, options, file_col="_file").withColumn("_file", _plain(F.col("_file")))
    # a label names the file itself or the folder it lies in
    rows = rows.withColumn("_folder", F.regexp_replace("_file", "/[^/]*$", ""))
    rows = rows.join(labels.select(F.col("path").alias("_file"), F.col("label").alias("_own")), "_file", "left") \
        .join(labels.select(F.col("path").alias("_folder"), F.col("label").alias("_of")), "_folder", "left")
    found = F.coalesce("_own", "_of", F.raise_error(F.concat(F.lit("file without a label: "), F.col("_file"))).cast("string"))
    return rows.select(*want.names, found.alias(label_col))
