"""Paraphrase generation (the reference's first pipeline stage).

pairs --TXT-4 prompt of the chosen side--> generator (GEN-1 dedupe or GEN-2
consecutive reuse) --TXT-6 clean (optional)--> GEN-4 substitute
--> canonical pairs with text_version 'paraphrase'
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.answers import clean_paraphrase
from ..functions.prompts import paraphrase_prompt, side_sentence
from ..operators.generate import generate, substitute_paraphrase
from ..operators.runs import reuse_consecutive


def paraphrase_pairs(pairs: DataFrame, factory: Callable, model: str, side,
                     config: EvalConfig, prompt_type: str = "instruct",
                     reuse: str = "distinct", clean: bool = True,
                     order_cols: list[str] | None = None,
                     partition_cols: list[str] | None = None,
                     materialize: bool = True, batch_size: int | None = None,
                     partitions: int | None = None, bucket_bits: int | None = None, sub_bits: int | None = None) -> DataFrame:
    """Rewrite the premise (``side='p'``) or hypothesis (``'h'``) of every pair;
    ``side`` may also be a column holding 'p' or 'h' per row.

    ``reuse='distinct'``: one call per distinct sentence (GEN-1).
    ``reuse='consecutive'``: one call per run of consecutive equal sentences
    in ``order_cols`` order (GEN-2, the remote-API behaviour; exact even
    for a sampled generator).
    ``clean``: apply TXT-6 (the local-model paraphraser cleans, the remote
    one does not).
    ``paraphrase_source`` names the model, so that predictions on the texts of
    two models stay apart in the store.
    ``materialize``: store the result in the shared folder and return the
    stored table. A sampled generator gives different text each time a plan
    is recomputed; an evaluation reads its input in two branches (rows and
    distinct requests), which must see the same paraphrases."""
    if isinstance(side, str) and side not in ("p", "h"):
        raise ValueError("side must be 'p' or 'h'")
    side_col = F.lit(side) if isinstance(side, str) else side
    config.model(model)
    prefix = config.prompt("paraphrase_gen", prompt_type).prefix
    rows = (pairs.withColumn("_side", side_col)
                 .withColumn("_sent", side_sentence(F.col("_side"), "premise", "hypothesis"))
                 .withColumn("model", F.lit(model)))
    prompt = paraphrase_prompt(F.lit(prefix), F.col("_sent"))
    if reuse == "distinct":
        out = generate(rows, factory, prompt=prompt, keys=["model", "_sent"], answer_col="_raw",
                       batch_size=batch_size, partitions=partitions)
    elif reuse == "consecutive":
        out = reuse_consecutive(rows, factory, order_cols or ["pair_id"], "_sent", prompt,
                                model=model, partition_cols=partition_cols or ["dataset"],
                                answer_col="_raw", bucket_bits=bucket_bits, batch_size=batch_size,
                                partitions=partitions, sub_bits=sub_bits).drop("is_new", "run_no")
    else:
        raise ValueError("reuse must be 'distinct' or 'consecutive'")
    para = clean_paraphrase("_raw") if clean else F.col("_raw")
    out = out.withColumn("_para", para).drop("_raw", "_sent", "model")
    out = (substitute_paraphrase(out, F.col("_side"), "_para").drop("_side")
           .withColumn("text_version", F.lit("paraphrase")).withColumn("paraphrase_source", F.lit(model)))
    if materialize:
        from ..session import materialize as write_back
        out = write_back(out, "paraphrases")
    return out
