"""Load a configured dataset into the canonical pair table (SRC-1, SRC-8,
PRJ-1..3, FLT-1).

canonical: dataset, pair_id, language, premise, hypothesis, gold_label,
           text_version, original_sentence, changed_side, paraphrase_source
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EvalConfig
from ..operators.checks import assert_domain, assert_not_null
from ..sources import readers as R

PARAPHRASE_SIDES = {"original_premise": "p", "original_hypothesis": "h"}


def _read_strings(spark: SparkSession, path: str, columns: list[str], fmt: str | None,
                  multiline: bool = True, order_col: str | None = None) -> DataFrame:
    """Read a pair file as strings, with the rows' numbers in file order. Delimited files are matched to names by
    their header (Spark reads one line for it, no inference pass); JSON gets
    an explicit all-string schema of the wanted columns."""
    kind = R.format_of(path, fmt)
    if kind in ("json", "jsonl"):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return R.load_dataset(spark, path, schema, kind, order_col=order_col)
    sep = "\t" if kind == "tsv" else ","
    header = (spark.read.option("sep", sep).option("header", True).option("quote", '"')
              .option("escape", '"').option("multiLine", multiline).csv(path).columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return R.load_dataset(spark, path, schema, kind, multiline=multiline, order_col=order_col)


def load_pairs(spark: SparkSession, config: EvalConfig, dataset: str,
               text_version: str = "original", language: str | None = None,
               path: str | None = None, fmt: str | None = None,
               require_text: bool = True, label_domain=None, multiline: bool = True,
               require_language: bool = True, paraphrase_source: str | None = None) -> DataFrame:
    """One configured dataset as canonical pairs.

    Original text uses the configured role columns and lower-cases labels;
    paraphrase tables always use ``premise``/``hypothesis``/``gold_label``
    (as the paraphrase step writes them) and keep labels as they are. The
    replaced original sentence is the table's last column.

    ``require_text``: a missing premise or hypothesis fails the job (in the
    plan, no extra pass) instead of being rendered into a prompt.
    ``label_domain``: optionally fail on labels outside this set (CHK-1).
    ``multiline=False``: delimited files are split (no field may hold a line break).
    ``paraphrase_source``: who wrote the paraphrases (default: the name of the
    table's path without its suffix); NULL for original text.
    ``require_language=False``: a dataset without a ``language`` column skips
    the language filter instead of failing. A JSON record without the key has
    a NULL language: it fails the filter's check, or is kept by the skip."""
    spec = config.dataset(dataset)
    if text_version == "original":
        path = path or spec.data_path
        prem, hyp, lab = spec.prem_col, spec.hyp_col, spec.label_col
    elif text_version == "paraphrase":
        path = path or spec.data_path_paraphrase
        prem, hyp, lab = "premise", "hypothesis", "gold_label"
    else:
        raise ValueError("text_version must be 'original' or 'paraphrase'")
    if not path:
        raise ValueError(f"no {text_version} path configured for {dataset!r}")
    wanted = [prem, hyp, lab, "language", *PARAPHRASE_SIDES]
    # rows are numbered in file order as they are read, before any filter
    df = _read_strings(spark, path, wanted, fmt, multiline, "_pair_id").withColumnRenamed("_pair_id", "pair_id")
    missing = [c for c in (prem, hyp, lab) if c not in df.columns]
    if missing:
        raise KeyError(f"{path}: columns {missing} not found in {df.columns}")
    last = df.columns[-2]
    if language is not None:
        json = R.format_of(path, fmt) in ("json", "jsonl")
        if "language" not in df.columns:
            if require_language:
                raise KeyError(f"language filter on {path}, which has no 'language' column")
        elif json and require_language:
            # JSON has the column by its schema; a record without the key fails in the plan
            df = assert_not_null(df, ["language"]).filter(F.col("language") == F.lit(language))
        elif json:
            df = df.filter(F.coalesce(F.col("language") == F.lit(language), F.lit(True)))
        else:
            df = df.filter(F.col("language") == F.lit(language))
    lang = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
    label = F.lower(F.col(lab)) if text_version == "original" else F.col(lab)
    original = F.lit(None).cast("string")
    side = F.lit(None).cast("string")
    writer = None
    if text_version == "paraphrase":
        if last in PARAPHRASE_SIDES:
            original, side = F.col(last), F.lit(PARAPHRASE_SIDES[last])
        else:
            original = F.col(last)
        writer = paraphrase_source or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = df.select(F.lit(dataset).alias("dataset"), "pair_id", lang.alias("language"),
                    F.col(prem).alias("premise"), F.col(hyp).alias("hypothesis"),
                    label.alias("gold_label"), F.lit(text_version).alias("text_version"),
                    original.alias("original_sentence"), side.alias("changed_side"),
                    F.lit(writer).cast("string").alias("paraphrase_source"))
    if require_text:
        out = assert_not_null(out, ["premise", "hypothesis"])
    if label_domain is not None:
        out = assert_domain(out, "gold_label", label_domain)
    return out


def load_all(spark: SparkSession, config: EvalConfig, datasets: list[str] | None = None,
             versions=("original",), language: str | None = None, multiline: bool = True,
             require_language: bool = False) -> DataFrame:
    """GRD-2 + SRC-8: every configured dataset (and version) in one table. The
    language filter applies to the datasets that have a language."""
    out = None
    for name in datasets or list(config.datasets):
        for v in versions:
            df = load_pairs(spark, config, name, v, language, multiline=multiline,
                            require_language=require_language)
            out = df if out is None else out.unionByName(df)
    return out
