"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees: (tree_id, node_id, parent_id, role, text, score).  Root-to-leaf
paths come from self-joins that double their reach (a path of n turns takes log2 n
rounds), carry ids only, and gather the texts once, at the end.  Branches are ranked by
the sum of their scores and each chosen path is formatted as one conversation, which is
one value and so is put together by one task.

Template: ``<s>``, then for each turn ``[INST] role [/INST]text</s>``.  Inside roles and
texts a control string gets a backslash after its first character (one more if it has
some already), so that no text holds a control string and reading back removes exactly
what was added.  The loss mask covers the assistant's texts.

Defined results: null text and null role are empty; a null score counts as 0; messages with
a null tree_id are one tree; a null node_id takes no part; rows with equal ids are one
message, the least of them; a missing parent makes a root; a node that reaches no root (a
cycle) is in no path; equal scores rank by leaf id; columns other than those named are
ignored; an empty table gives no conversations.  Rows of a conversation go by turn (null
turns first), role and text; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, settled

#: The control strings of the template.
OPEN, CLOSE, TURN_OPEN, TURN_CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
#: A control string, its first character apart, with the backslashes of an escaped one.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
#: The same with one backslash at least.
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """A text in which no control string is left."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` had."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, node_id, steps): the nodes of the path of every leaf, one row each,
    with their steps above the leaf.

    Going up, round i gives each node that has one its ancestor 2**i above, by joining the
    round before with itself.  Going down again from the last round to the first, the
    nodes found so far of each leaf's path take the round's ancestors, which makes each node
    of a path once.  Rows hold ids only: a round up writes a row for each node at most, and
    the rounds down together twice the rows of the paths besides one row for each leaf.  A
    node with an ancestor as many steps above as its tree has nodes is in a cycle or below
    one, and goes.
    """
    nodes = messages.select("tree_id", "node_id", "parent_id")
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    sizes = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("tree_nodes"))
    linked = materialise(
        nodes.join(parents, ["tree_id", "parent_id"], "left")
        .join(sizes, "tree_id")
        .select("tree_id", "node_id", F.when(F.col("has_parent"), F.col("parent_id")).alias("up"), "tree_nodes")
    )
    inner = linked.where("up is not null").select("tree_id", F.col("up").alias("node_id")).distinct()
    leaves = linked.join(inner, ["tree_id", "node_id"], "left_anti")
    jump, jumps, reach = linked.where("up is not null"), [], 1
    while not jump.isEmpty():
        jumps.append(jump)
        above = jump.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next_up"))
        further = materialise(
            jump.join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("next_up").alias("up"), "tree_nodes")
        )
        reach *= 2
        lost = further.where(F.col("tree_nodes") <= reach).select("tree_id", "node_id")
        leaves = leaves.join(lost, ["tree_id", "node_id"], "left_anti")
        jump = further.where(F.col("tree_nodes") > reach)
    paths = materialise(leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).alias("steps")))
    for i in reversed(range(len(jumps))):
        ways = jumps[i].select("tree_id", "node_id", "up")
        higher = paths.join(ways, ["tree_id", "node_id"]).select(
            "tree_id", "leaf_id", F.col("up").alias("node_id"), (F.col("steps") + (1 << i)).alias("steps")
        )
        paths = materialise(paths.unionByName(higher))
    return paths


def one_row_each(messages: DataFrame) -> DataFrame:
    """The named columns of messages that have a node_id, with a key that is never null in
    place of tree_id; of rows with equal ids the least."""
    rows = messages.where("node_id is not null").select(
        F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("")).alias("tree_id"),
        "node_id",
        "parent_id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
    if rows.groupBy("tree_id", "node_id").count().where("count > 1").isEmpty():
        return rows
    least = F.min(F.struct("parent_id", "role", "text", "score")).alias("least")
    return materialise(rows.groupBy("tree_id", "node_id").agg(least).select("tree_id", "node_id", "least.*"))


def formatted_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, branch (rank from 1), score, formatted.

    ``branches`` keeps the best-scored paths of each tree; None keeps all.
    """
    kind = messages.schema["tree_id"].dataType
    rows = one_row_each(messages)
    steps = root_to_leaf_paths(rows)
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    ranked = (
        steps.join(rows.select("tree_id", "node_id", "score"), ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf_id")
        .agg(F.sum("score").alias("score"))
        .withColumn("branch", F.row_number().over(best))
    )
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = materialise(ranked)
    said = rows.select(
        "tree_id",
        "node_id",
        F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(TURN_CLOSE), escape(F.col("text")), F.lit(CLOSE)).alias("turn"),
    )
    chosen = steps.join(ranked.select("tree_id", "leaf_id"), ["tree_id", "leaf_id"], "left_semi")
    whole = (
        chosen.join(said, ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), "turn"))).alias("turns"))
        .select(
            "tree_id", "leaf_id", F.concat(F.lit(OPEN), F.array_join(F.col("turns.turn"), "")).alias("formatted")
        )
    )
    return ranked.join(whole, ["tree_id", "leaf_id"]).withColumn(
        "tree_id", F.when(F.col("tree_id") != "", F.substr("tree_id", F.lit(2))).cast(kind)
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    body = F.substr(formatted, F.lit(len(OPEN) + 1))
    turns = F.filter(F.split(body, r"</s>"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(TURN_OPEN) + 1)), TURN_CLOSE, 1)).alias("role"),
            unescape(F.substr(t, F.instr(t, TURN_CLOSE) + len(TURN_CLOSE))).alias("text"),
        ),
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, in order."""
    under = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(under, lambda t: t["text"]), "")


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as chains: each row answers the one before
    it by turn (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy(
        F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    )
    return conversations.select(
        F.col("conv_id").cast("long").alias("tree_id"),
        F.row_number().over(order).cast("long").alias("node_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    ).withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))


@settled
def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    messages = materialise(conversations_as_messages(conversations))
    formatted = formatted_paths(messages, branches=1)
    read = formatted.select(F.col("tree_id").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    under = loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
