"""Chat formatting of reply trees.

Messages are nodes (tree, node, parent). Tables of the ancestors at distance 1, 2, 4, ... come from joining each table with
itself until no node has an ancestor so far up; every leaf is then joined with these tables from the farthest down, which
lists each node of its path to the root exactly once. So a path of n turns takes about 2 log2(n) joins, and no step makes
more rows than the paths have. Leaves are ranked in their tree by the mean score of their path; each chosen path is
formatted as one conversation.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (a role's line feed ``&#10;``), so that no control string can come from a text and every text can be read
back. The loss mask covers each assistant text and nothing else, as spans in code points.

Defined results: null texts, roles and scores count as empty, empty and 0; rows of a null tree are one tree (trees are
joined as structs, which are equal where both hold null); a parent that is no node of the tree makes a
root; nodes whose ancestors run in a circle have no root and are left out, with their circle; equal scores are ranked by
leaf; of rows with one node id in a tree the least counts (by parent and score, and by role and text); rows without a node id
are left out; conversations stored by turn number their rows anew, so that none is lost; an empty table gives no conversations;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
#: Distances double; a path has less than 2**MAX_LEVELS turns.
MAX_LEVELS = 40


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("&#10;"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("&#10;"), F.lit("\n")))


def leaf_paths(nodes: DataFrame, work: Scratch, per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, node, up, path_score, rank) of every root-to-leaf path (the best per_tree of each tree, if told); up counts
    from the leaf, rank from 1. nodes: tree, node, parent, score."""
    bare = nodes.where("node is not null").groupBy(F.struct("tree").alias("tree"), "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("x"))
    bare = work.save(bare.select("tree", "node", "x.parent", "x.score"), "nodes")
    known = bare.select("tree", F.col("node").alias("parent"))
    step = work.save(bare.select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("anc")), "anc")
    ladder: list[DataFrame] = []
    last, most = None, max(1, bare.count()).bit_length()
    while not step.isEmpty():
        if len(ladder) > min(most, MAX_LEVELS):
            last = step  # those still going run in a circle
            break
        ladder.append(step)
        a, b = step.alias("a"), step.alias("b")
        step = work.save(a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.anc") == F.col("b.node"))).select("a.tree", "a.node", "b.anc"), "anc")
    leaves = bare.join(ladder[0].select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti") if ladder else bare
    if last is not None:
        leaves = leaves.join(last.select("tree", "node"), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(ladder) - 1, -1, -1):
        paths = paths.join(ladder[k], ["tree", "node"], "left").select(
            "tree", "leaf", F.inline(F.filter(F.array(F.struct("node", "up"), F.struct(F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))), lambda x: x["node"].isNotNull()))
        )
    paths = work.save(paths, "paths")
    scored = paths.join(bare.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")).cast("long"))
    if per_tree is not None:
        best = best.where(F.col("rank") <= per_tree)
    return paths.join(best, ["tree", "leaf"]).withColumn("tree", F.col("tree.tree"))


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, rank, path_score, n_turns, formatted, loss_spans (start, end). messages: tree, node, role,
    text."""
    role, text = F.coalesce("x.role", F.lit("")), F.coalesce("x.text", F.lit(""))
    once = messages.groupBy(F.struct("tree").alias("tree"), "node").agg(F.min(F.struct("role", "text")).alias("x"))
    turn = paths.select(F.struct("tree").alias("tree"), F.struct("leaf", "rank", "path_score").alias("leaf"), "node", "up").join(
        once.select("tree", "node", (role == "assistant").alias("told"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body")), ["tree", "node"]
    )
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("piece").cast("long")).over(so_far) - F.length("body") - len(END) - 1
    turn = turn.select("tree", "leaf", (-F.col("up")).alias("at"), "piece", "told", start.alias("start"), (start + F.length("body")).alias("end"))
    whole = turn.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "told", "start", "end"))).alias("t"))
    return whole.select(
        F.col("tree.tree").alias("tree"),
        "leaf.*",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["told"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def parse(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        size = F.length(head)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substr(x, size + 2, F.length(x) - size - 2 - len(END))).alias("text"))

    return F.transform(turns, parse)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, messages) of conversations stored by turn: each row replies to the one before it. Rows of one turn are told
    apart by role and text; equal rows are as many turns."""
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    m = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    m = m.withColumn("node", F.row_number().over(w).cast("long"))
    nodes = m.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    return nodes, m.select("tree", "node", "role", "text")


def format_conversations(rows: DataFrame, per_tree: int | None = None, **names: str) -> DataFrame:
    """As ``format_paths``, of conversations stored by turn; a turn's score is its number of words, so that of several branches
    the one that says more comes first."""
    work = Scratch(rows.sparkSession, "chat")
    _, messages = from_turns(rows, **names)
    messages = work.save(messages, "messages")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+", -1), lambda w: w != "")).cast("double")
    nodes = messages.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), words.alias("score"))
    return format_paths(leaf_paths(nodes, work, per_tree), messages)
