"""Reply trees as chat text, with DataFrame functions only.

Self-joins double their reach: round k knows of every node its ancestor 2**k steps up and the scores in between, and
joins this with itself, so that a chain of n replies takes log2(n) rounds.  Branches are ranked by score inside their
tree; only the paths of chosen ones are enumerated, by the same jumps, and each becomes one conversation with a loss
mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.llm._shared import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Adds a backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ..., so that no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Roles also have their line breaks escaped, since a line break ends a role."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def climb(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, total, n): the scores from each node up to its root, and their number; and the tables of jumps.

    ``nodes`` has tree, node, parent and score.  Table k of the jumps has (tree, node, up): the ancestor 2**k steps up.
    Round k joins what is known of 2**k steps with itself, so that only nodes travel, never paths.
    """
    up = F.when(F.col("parent") < F.col("node"), F.col("parent"))
    known = nodes.select("tree", "node", up.alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n"))
    there = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("_there"))
    known = known.join(there, ["tree", "up"], "left").withColumn("up", F.when(F.col("_there"), F.col("up"))).select("tree", "node", "up", "total", "n")
    known, jumps = scratch.save(known, "climb-0"), []
    while True:
        on = known.where("up is not null").select("tree", "node", "up", "total", "n")
        if on.isEmpty():
            return known.select("tree", "node", "total", "n"), jumps
        jumps.append(on.select("tree", "node", "up"))
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        further = on.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
        known = scratch.save(known.where("up is null").unionByName(further), f"climb-{len(jumps)}")


def chosen_paths(leaves: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(tree, leaf, node, above) for every given (tree, leaf) and every node from it up to its root, ``above`` steps from it."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("above"))
    for k, jump in enumerate(jumps):
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        # Each round's new rows are a table of their own; the path is the union of all rounds.
        paths = paths.unionByName(scratch.save(further, f"paths-{k}"))
    return paths


def format_reply_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One conversation for each of the ``branches`` best paths of every tree (all of them if None).

    ``nodes`` has tree (string), node, parent (long), role, text (string) and score (double); node ids are unique in a
    tree, and a reply's id is above its parent's: a parent that is missing or not below makes a node a root.  A path's
    score is the mean over its nodes, null scores as 0; ties go to the smaller leaf.  Null roles and texts are empty.
    Returns tree, leaf, rank, score, n_turns, formatted and loss, the spans [start, stop) of the assistant texts in
    code points of ``formatted``.  An empty table gives an empty result, long texts are kept whole, and other columns are
    ignored.  A node id that a tree repeats breaks the contract: its rows then stand on every path through the id.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = scratch.save(nodes.select("tree", F.col("node").cast("bigint"), F.col("parent").cast("bigint"), text("role").alias("role"), text("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    sums, jumps = climb(nodes.select("tree", "node", "parent", "score"), scratch)
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else None
    leaves = sums if inner is None else sums.join(inner, ["tree", "node"], "left_anti")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    ranked = scratch.save(ranked, "ranked")
    paths = chosen_paths(ranked, jumps, scratch)
    turns = paths.join(ranked, ["tree", "leaf"]).join(nodes.drop("score", "parent"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).withColumn("stop", F.col("start") + F.length("body"))
    span = F.when(F.col("role") == "assistant", F.struct("start", "stop"))
    out = turns.groupBy("tree", "leaf", "rank", "score").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "piece", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return out.select("tree", "leaf", "rank", "score", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    end = len(END)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        return F.struct(unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(piece, cut + 1, F.length(piece) - cut - end)).alias("text"))

    pieces = F.split(formatted, START.replace("|", r"\|"), -1)
    return F.transform(F.filter(pieces, lambda _, i: i > 0), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return F.array_join(F.transform(loss, cut), "")
