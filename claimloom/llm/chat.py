"""Chat formatting of reply trees, with DataFrame operations only.

Self-joins double the ancestor that each message knows, so a path of n messages takes log2(n) of
them. Leaves are ranked by the score of their whole path; the messages of each chosen path are found
again by the same steps, from the longest down, and become one formatted conversation with the
spans of its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import written

#: The template: <turn>ROLE<text>TEXT</turn> and a line feed. "<" starts its control strings.
OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"


def escaped(text: Column) -> Column:
    """Reversible: afterwards no "<" is left, and each backslash is followed by b or l."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def reply_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as a tree in which each message answers the one before. Ties of `turn` go by role and text."""
    w = Window.partitionBy("conv_id").orderBy("at", "role", "text")
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("at"), _text(turns, "role"), _text(turns, "text"))
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit("")).alias(name)


def format_trees(messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """Formats the `branches` best paths of every reply tree (None: all paths).

    `messages`: conv_id, node, parent, role, text, score. Of rows that repeat a node of a conversation the
    first by (parent, role, text, score) counts; rows without a node are left out. A path's
    score is the sum of its messages' (null: 0); ties go to the longer path, then to the smaller leaf.
    A message whose parent is null or missing is a root; messages on a cycle have no root and are left
    out. Null roles and texts are empty; a null conv_id is a conversation like any other. A very long
    text is copied whole; a conversation's output is one row, as long as its messages together. An
    empty table gives no rows. Other columns are not read.

    Returns conv_id, leaf, branch (1: best), score, n_turns, formatted and loss_spans, an array of
    (start, n) in code points of `formatted`: each `loss_role` text, without its marks.
    """
    m = messages.select("conv_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), _text(messages, "role"), _text(messages, "text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = written(m.where("node is not null"), "chat")
    if not m.groupBy("conv_id", "node").count().where("count > 1").isEmpty():
        first = m.groupBy("conv_id", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        m = written(first.select("conv_id", "node", "m.*"), "chat")
    nodes = m.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    links = m.select("conv_id", "node", "parent", "score")
    own = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("parent") == F.col("n"))
    size = links.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 1

    level = links.join(nodes, own, "left").select("conv_id", "node", F.col("n").alias("up"), F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("far"), "score")
    level = written(level, "chat-level")
    done, open_ = level.where("up is null"), level.where("up is not null")
    levels = []
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))
    for _ in range((size - 1).bit_length()):  # what is still open then lies on a cycle
        if open_.isEmpty():
            break
        levels.append(open_)
        # only messages that haven't met their root are joined; `score` covers the messages from the node up to, not including, `up`
        above = done.unionByName(open_).select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("next_up"), F.col("far").alias("more"), F.col("score").alias("gain"))
        level = written(open_.join(above, on).select("conv_id", "node", F.col("next_up").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("score") + F.col("gain")).alias("score")), "chat-level")
        done, open_ = done.unionByName(level.where("up is null")), level.where("up is not null")

    answered = links.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("n")).distinct()
    leaves = done.join(answered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("far"), "node"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    path = chosen.select("conv_id", F.col("node").alias("leaf"), "branch", F.col("score").alias("path_score"), F.col("far").alias("depth"), "node")
    for step in reversed(levels):
        jump = step.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up", "far")
        hop = F.array(F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - F.col("far")).alias("depth")))
        path = path.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left").select("conv_id", "leaf", "branch", "path_score", F.explode(hop).alias("hop")).select("conv_id", "leaf", "branch", "path_score", "hop.node", "hop.depth").where("node is not null")

    said = m.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    key = ["conv_id", "leaf", "branch", "path_score"]
    turns = path.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turns = turns.select(*key, "depth", (F.col("role") == loss_role).alias("loss"), escaped(F.col("role")).alias("r"), escaped(F.col("text")).alias("t"))
    turns = turns.select(*key, "depth", "loss", F.concat(F.lit(OPEN), "r", F.lit(MIDDLE)).alias("head"), "t")
    before = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    marked = F.char_length("head") + F.char_length("t") + len(CLOSE)
    turns = turns.withColumn("start", F.coalesce(F.sum(marked.cast("long")).over(before), F.lit(0)) + F.char_length("head"))
    rows = F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "t", F.lit(CLOSE)).alias("turn"), "loss", "start", F.char_length("t").cast("long").alias("n"))))
    out = turns.groupBy(*key).agg(rows.alias("rows"))
    return out.select(
        "conv_id", "leaf", F.col("branch").cast("long").alias("branch"), F.col("path_score").alias("score"), F.size("rows").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("rows", lambda x: x["turn"])).alias("formatted"),
        F.transform(F.filter("rows", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """`turns` (array of role, text) and `loss` (array of unescaped texts under the mask), from the formatted text alone."""
    marked = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    turns = F.transform(marked, lambda x: F.struct(unescaped(F.substr(F.substring_index(x, MIDDLE, 1), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substring_index(x, MIDDLE, -1)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["n"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss": loss})
