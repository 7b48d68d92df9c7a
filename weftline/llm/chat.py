"""Chat formatting of reply trees: every root-to-leaf path, ranked, as one conversation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

#: Fixed strings of the template: each turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>", "</s>"
#: Strings that texts and roles may not hold as they are: a backslash goes after the first character.
CONTROL = (OPEN, CLOSE, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""Backslashes doubled, then each control string broken by a backslash after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> (conv_id, node, parent, role, text, score): each row answers the one
    before it by turn; of equal turns, by role and text. Null turns come first, nulls are empty texts."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(order).cast("long") - 1
    rows = rows.withColumn("node", node)
    return rows.select("conv_id", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """Reply trees (conv_id, node, parent, ...; parent null at a root) -> (conv_id, leaf, node, depth):
    each leaf's path, depth counted from the leaf.

    Self-joins that double their reach: after round k each node points 2^k ancestors up, and each leaf's
    path has its 2^k lowest nodes, to which the join adds the ancestors of those. A pointer past the root
    is dropped, so the rounds, whose number is the logarithm of the deepest path, only carry the deeper
    trees on. A parent that does not exist ends the path; cycles are refused."""
    known = nodes.select("conv_id", "node").distinct()
    up = nodes.filter("parent is not null").select("conv_id", "node", "parent").distinct()
    real = known.withColumnsRenamed({"conv_id": "c", "node": "n"})
    up = scratch.keep(up.join(real, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n"))).select("conv_id", "node", F.col("n").alias("up")), "up-0")
    answered = up.select(F.col("conv_id").alias("c"), F.col("up").alias("n")).distinct()
    leaves = known.join(answered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    lines = scratch.keep(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")), "lines-0")
    reach = 1
    for k in range(1, most_rounds + 1):
        if up.isEmpty():
            return lines
        jump = up.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("to"))
        more = lines.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        more = more.select("conv_id", "leaf", F.col("to").alias("node"), (F.col("depth") + reach).alias("depth"))
        lines = scratch.keep(lines.unionByName(more), f"lines-{k}")
        far = up.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")))
        up = scratch.keep(far.select("conv_id", "node", F.col("to").alias("up")), f"up-{k}")
        scratch.drop(f"lines-{k - 1}", f"up-{k - 1}")
        reach *= 2
    raise ValueError(f"a path of over 2^{most_rounds} nodes: the parents form a cycle")


def formatted(nodes: DataFrame, scratch: Scratch, best: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Reply trees (conv_id, node, parent, role, text, score) -> one row per path: conv_id, leaf, rank (from 1, by
    mean score of the path, best first, then leaf), score, formatted, loss (array of start and length,
    in characters of formatted, of the escaped texts of loss_role). best: paths kept of each tree, all
    if None. Node ids are unique in a tree; null roles, texts and scores are '', '' and 0."""
    lines = paths(nodes, scratch)
    own = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    match = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    turns = lines.join(own, match).select("conv_id", "leaf", "depth", "score", F.struct((-F.col("depth")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss")).alias("turn"))
    whole = turns.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.avg("score").alias("score"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    empty = F.array().cast("array<struct<start:int,length:int>>")
    end = len(END)

    def step(state, turn):
        begin = state["at"] + F.length(turn["head"])
        size = F.length(turn["body"])
        span = F.array(F.struct((begin + 1).alias("start"), size.alias("length")))
        return F.struct((begin + size + end).alias("at"), F.when(turn["loss"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    mask = F.aggregate("turns", F.struct(F.lit(0).alias("at"), empty.alias("loss")), step)["loss"]
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return ranked.select("conv_id", "leaf", "rank", "score", text.alias("formatted"), mask.alias("loss"))


def parsed(chat: Column) -> Column:
    """A formatted conversation back into its turns, as an array of (role, text). The end of a role is looked for
    behind OPEN, so that a role may start with the last character of CLOSE."""
    pieces = F.split(chat, "\\Q" + END + "\\E", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    inner = F.transform(turns, lambda t: t.substr(F.lit(len(OPEN) + 1), F.length(t)))
    return F.transform(
        inner,
        lambda t: F.struct(
            unescaped(F.substring_index(t, CLOSE, 1)).alias("role"),
            unescaped(t.substr(F.instr(t, CLOSE) + len(CLOSE), F.length(t))).alias("text"),
        ),
    )


def loss_text(chat: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return unescaped(F.array_join(F.transform(loss, lambda x: chat.substr(x["start"], x["length"])), ""))
