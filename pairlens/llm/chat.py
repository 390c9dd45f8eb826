"""Reply trees to chat text (operator 9).

Messages form trees by parent id. Self-joins on the parent pointer, doubling
its reach each time, give every message its depth and the score of its path
to the root in log2(depth) joins; branches (root-to-leaf paths) are ranked by
that score, and the chosen ones are enumerated with the same pointers and
formatted, one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside roles and
texts, ``<``, any number of backslashes, ``|`` gets one backslash more, so no
control string can arise there, and :func:`unescape` takes it out again (in
roles also a line break becomes ``<|n|>``).

Defined cases: a null text or role is the empty string; a parent that isn't
in the tree (or null) makes a root; messages on or below a parent cycle have
no root and are in no branch; a null tree id is a tree of its own; ties in
score go to the deeper, then to the smaller leaf id; equal message ids within
a tree count once (the smallest parent, role and text); an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _role_out(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<|n|>"))


def _role_in(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<|n|>"), F.lit("\n")))


def linear_messages(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of linear conversations as trees: each turn replies to the one
    before. Equal turn numbers go by role, then text."""
    w = Window.partitionBy("tree").orderBy("_turn", "role", "text")
    rows = df.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("_turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.row_number().over(w).cast("bigint")
    return rows.select("tree", n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def branches(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of ``messages`` (tree, msg, parent, role, text,
    score): one row per message on each chosen path -- tree, leaf, pos (from
    1), rank, branch_score, role, text. ``per_tree`` branches of the best
    score are kept per tree; None keeps all."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("\u0000"))
    msgs = (messages.groupBy(key.alias("_t"), "msg")
            .agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("m"))
            .select("_t", "msg", "m.*")
            .withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0))))
    msgs = cut(msgs)
    known = msgs.select(F.col("_t"), F.col("msg").alias("parent"), F.lit(True).alias("_known"))
    # level 0: pointer to the parent; s and d: score and messages from here up to (not with) the pointer's target
    level = cut(msgs.join(known, ["_t", "parent"], "left")
                .select("_t", "msg", F.when(F.col("_known"), F.col("parent")).alias("up"),
                        F.col("score").alias("s"), F.lit(1).cast("bigint").alias("d")))
    is_parent = level.filter(F.col("up").isNotNull()).select("_t", F.col("up").alias("msg")).distinct()
    leaves = level.select("_t", "msg").join(is_parent, ["_t", "msg"], "left_anti")
    most = msgs.groupBy("_t").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while True:
        open_ = level.filter(F.col("up").isNotNull())
        if (1 << len(levels)) > 2 * most or open_.limit(1).count() == 0:
            break
        levels.append(open_.select("_t", F.col("msg").alias("cur"), F.col("up").alias("to")))
        far = level.select("_t", F.col("msg").alias("up"), F.col("up").alias("up2"),
                           F.col("s").alias("s2"), F.col("d").alias("d2"))
        level = cut(open_.join(far, ["_t", "up"])
                    .select("_t", "msg", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"),
                            (F.col("d") + F.col("d2")).alias("d"))
                    .unionByName(level.filter(F.col("up").isNull()).select("_t", "msg", "up", "s", "d")))
    rooted = level.filter(F.col("up").isNull()).select("_t", "msg", F.col("s").alias("branch_score"), "d")
    order = Window.partitionBy("_t").orderBy(F.desc("branch_score"), F.desc("d"), "msg")
    chosen = leaves.join(rooted, ["_t", "msg"]).withColumn("rank", F.row_number().over(order))
    if per_tree is not None:
        chosen = chosen.filter(F.col("rank") <= per_tree)
    # one row per message of each path: its distance from the leaf, walked by the bits of the distance
    path = (chosen.select("_t", F.col("msg").alias("leaf"), F.col("msg").alias("cur"), "rank", "branch_score", "d",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("d") - 1)).alias("dist")))
    for k, lv in enumerate(levels):
        bit = F.col("dist").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0
        moved = path.filter(bit).join(lv, ["_t", "cur"]).drop("cur").withColumnRenamed("to", "cur")
        path = cut(moved.unionByName(path.filter(~bit)))
    return (path.join(msgs.withColumnRenamed("msg", "cur"), ["_t", "cur"])
            .select("_t", "tree", "leaf", (F.col("d") - F.col("dist")).alias("pos"), "rank", "branch_score",
                    "role", "text"))


def format_branches(path: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation per branch: tree, leaf, rank, branch_score,
    ``formatted`` and ``loss_spans``, the code point ranges (start from 0,
    length) of the texts that the loss counts."""
    role, text = _role_out(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = (path.withColumn("_head", head).withColumn("_body", text)
            .withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
            .withColumn("_n", F.length("_piece").cast("bigint")))
    w = Window.partitionBy("_t", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("bigint")) + F.length("_head"))
    span = F.when(F.col("role").isin(*loss_roles),
                  F.struct(F.col("_start").alias("start"), F.length("_body").cast("bigint").alias("length")))
    grouped = rows.groupBy("_t", "leaf").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("_piece").alias("piece"), span.alias("span")))).alias("_p"))
    return grouped.select(
        "tree", "leaf", "rank", "branch_score",
        F.concat_ws("", F.transform("_p", lambda x: x["piece"])).alias("formatted"),
        F.filter(F.transform("_p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    raw = F.split(formatted, r"<\|im_start\|>")
    each = F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0)))

    def turn(t):
        at = F.locate("\n", t)
        body = F.substring(t, at + 1, F.length(t) - at - len(END) - 1)
        return F.struct(_role_in(F.substring(t, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))
    return F.transform(each, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
