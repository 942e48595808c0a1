"""Chat formatting from reply trees, in DataFrame functions only.

Root-to-leaf paths come from iterative self-joins: 2**k-th ancestors of all messages are joined with themselves for the
next k. Leaves climb by them from the largest k down, and are ranked by the sum of scores on their way; the paths of the
chosen leaves are then filled in likewise, and each becomes one conversation. A tree of depth d takes about 3 log2(d)
joins, and no step makes more rows than the chosen paths have.

Format: START role newline text END newline for each turn. Control strings inside roles and texts lose their first
character to a character reference (&lt; or &lb;); a reference that the text has itself is written with &amp;. Newlines in
roles become &nl;. Undoing this gives the exact text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cambium.llm.common import Scratch, ranked

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
_REFERENCE = "&(?=(?:amp|lt|lb|nl);)"
_ANGLE = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, _REFERENCE, "&amp;")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "&lt;"), _SQUARE, "&lb;")


def unescape(text: Column) -> Column:
    for reference, plain in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n")):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return F.regexp_replace(text, "&amp;(?=(?:amp|lt|lb|nl);)", "&")


def _jumps(scratch: Scratch, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """[(tree, node, to, gain)] for k = 0, 1, ...: each message's 2**k-th ancestor, and the scores from the message up to
    before it; and the last of them where messages run in circles."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    first = nodes.where(F.col("parent").isNotNull()).join(known, ["tree", "parent"], "left_semi")
    jumps = [scratch.table(first.select("tree", "node", F.col("parent").alias("to"), F.col("score").alias("gain")), "jump-0")]
    size = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) >= max(1, size):  # more steps up than the tree has messages: circles
            return jumps[:-1], jumps[-1]
        last = jumps[-1]
        further = last.join(last.select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("gain").alias("more")), ["tree", "to"])
        jumps.append(scratch.table(further.select("tree", "node", F.col("next").alias("to"), (F.col("gain") + F.col("more")).alias("gain")), f"jump-{len(jumps)}"))
    return jumps, None


def branches_of(scratch: Scratch, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank, node, up): each chosen leaf with all messages up to its root. Takes (tree, node, parent, score).

    Leaves are ranked before any path is listed: one row a leaf climbs to its root by the largest jumps that it has, and
    sums the scores. A parent that is null or not in the tree makes its message a root. Messages that reach a circle have no
    root and no path. (tree, node) must be unique and not null.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    jumps, endless = _jumps(scratch, nodes)
    parents = jumps[0].select("tree", F.col("to").alias("node")).distinct()
    leaves = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("score"))
    if endless is not None:
        leaves = leaves.join(endless.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k].select("tree", F.col("node").alias("at"), "to", "gain")
        leaves = scratch.table(leaves.join(far, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("to", "at").alias("at"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score")), f"leaves-{k}")
    roots = nodes.select("tree", F.col("node").alias("at"), F.col("score").alias("own"))
    leaves = leaves.join(roots, ["tree", "at"]).select("tree", "leaf", (F.col("score") + F.col("own")).alias("score"))
    placed = ranked(scratch, leaves.withColumn("minus", -F.col("score")), ["tree"], ["minus", "leaf"], "ranked").withColumn("rank", (F.col("rank") + 1).cast("int"))
    chosen = placed if branches is None else placed.where(F.col("rank") <= branches)
    found = chosen.select("tree", "leaf", "score", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        found = scratch.table(found, f"paths-{k}")
        found = found.unionByName(found.join(jumps[k], ["tree", "node"]).select("tree", "leaf", "score", "rank", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up")))
    return found


def conversations_of_trees(spark: SparkSession, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Per chosen path: tree, leaf, rank, score, n_turns, formatted, loss (spans of code points to learn from).

    messages: tree, node, parent, role, text, score. rank orders a tree's paths by the sum of scores (null: 0), then leaf,
    from 1; branches keeps those up to that rank, None all. Null roles and texts are empty. Only turns of the assistant
    are under the loss mask, each text once. Other columns don't matter; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "chat")
    m = messages.select("tree", "node", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = scratch.table(m, "messages")
    rows = branches_of(scratch, m, branches).join(m.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", "&nl;"), F.lit("\n"))
    said = escape(F.col("text"))
    rows = rows.select("tree", "leaf", "up", "score", "rank", (F.col("role") == LEARNT).alias("learnt"), F.length(head).alias("head"), F.length(said).alias("said"), F.concat(head, said, F.lit(END + "\n")).alias("piece"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    rows = rows.withColumn("at", F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.col("head"))
    turns = rows.groupBy("tree", "leaf").agg(F.first("score").alias("score"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "piece", "learnt", "at", "said"))).alias("turns"))
    return turns.select(
        "tree", "leaf", "score", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["at"].alias("start"), t["said"].cast("long").alias("length"))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")

    def turn(part: Column) -> Column:
        role = F.substring_index(part.substr(F.lit(len(START) + 1), F.length(part)), "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(part.substr(F.length(role) + len(START) + 2, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Rows of one turn follow by role and text. A null conv_id is a conversation of its own; null turns come first.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    scratch = Scratch(conversations.sparkSession, "chains")
    rows = ranked(scratch, conversations.select(tree.alias("tree"), "turn", "role", "text"), ["tree"], ["turn", "role", "text"], "turns", "node", deal=["tree", "turn"])
    return rows.select("tree", (F.col("node") + 1).alias("node"), F.when(F.col("node") > 0, F.col("node")).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
