"""Chat formatting of reply trees.

Nodes are messages with a parent. Root-to-leaf paths are found by iterative self-joins that
double their reach: after round r every node knows its ancestor 2^r steps up and the sum of
the scores on the way, so a tree of depth d needs log2(d) rounds. Branches are ranked per
root by mean score, and the chosen ones are spelled out by walking the same tables down
again; texts join only at the end.

A conversation is written as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts
every ``<`` followed by backslashes and ``|`` gets one more backslash, so no text can hold a
control string and the change can be undone; a role has its backslashes and line breaks
escaped too. The loss mask is the list of character ranges of the assistant's texts.

Defined results for odd input: a null text is empty, a null role is an empty role, a null
score counts 0. A node whose parent is not in the table is a root. Nodes on a cycle reach no
root and belong to no path. Repeated node ids are refused by nothing: each row with an id
hangs its children once more, so ids should be unique; ``from_turns`` makes them so. Equal
scores are ranked by leaf id. An empty table gives no conversations. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept_table

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Undoes ``escaped_role``; between doubled backslashes only escaped line breaks are left."""
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Nodes (tree, node, parent, role, text, score) of plain conversations, one after the other.

    Equal turns are ordered by role and text, null turns come first.
    """
    numbered = kept_table(
        turns.select("conv_id", "turn", "role", "text").withColumn("node", F.monotonically_increasing_id()), "turns"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.lag("node").over(order).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables node -> ancestor 2^r up, for every r, and (node, root, depth, score) of all nodes."""
    known = nodes.select(F.col("node").alias("id"))
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    links = links.join(known, links["parent"] == known["id"], "left").select(
        "tree", "node", F.when(F.col("id").isNotNull(), F.col("parent")).alias("up"), "score"
    )
    # far: ancestor reached so far (null: the root is passed), last: last node on the way
    table = kept_table(links.select(
        "tree", "node", "up", F.lit(1).cast("long").alias("depth"), "score", F.col("node").alias("root")
    ), "jumps")
    tables, total, rounds = [table.select("node", "up")], table.count(), 0
    while rounds <= total.bit_length() and not table.filter("up is not null").isEmpty():
        above = table.select(
            F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"),
            F.col("score").alias("score2"), F.col("root").alias("root2"),
        )
        moving = table.filter("up is not null").join(above, "up").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"),
            (F.col("score") + F.col("score2")).alias("score"), F.col("root2").alias("root"),
        )
        table = kept_table(moving.unionByName(table.filter("up is null")), "jumps")
        tables.append(table.select("node", "up"))
        rounds += 1
    return tables, table.filter("up is null").drop("up")


def branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` root-to-leaf paths of each root: (tree, root, leaf, rank, score, at, node).

    ``at`` counts from the root. Score is the mean over the path.
    """
    tables, placed = _jumps(nodes)
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = placed.join(parents, "node", "left_anti").withColumn("mean", F.col("score") / F.col("depth"))
    order = Window.partitionBy("root").orderBy(F.col("mean").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    walk = chosen.select("tree", "root", F.col("node").alias("leaf"), "rank", F.col("mean").alias("score"), "node", F.col("depth").alias("at"))
    for r in range(len(tables) - 2, -1, -1):  # largest steps first: every node on the way is met once
        up = tables[r].filter("up is not null")
        above = walk.join(up, "node").withColumns({"node": F.col("up"), "at": F.col("at") - (1 << r)}).drop("up")
        walk = kept_table(walk.unionByName(above), "walk")  # else the plan doubles with every step
    return walk


def formatted(nodes: DataFrame, best: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One conversation per chosen path: tree, leaf, rank, score, text and loss spans.

    A span is a struct (start, length) in code points of the formatted text.
    """
    texts = nodes.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turn = F.struct(
        "at", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("learn"),
    )
    ordered = branches(nodes, best).join(texts, "node").groupBy("tree", "leaf", "rank", "score").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    tail = len(END) + 1

    def advance(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        return F.struct(
            (begin + F.length(t["body"]) + tail).alias("at"),
            F.when(
                t["learn"], F.concat(state["spans"], F.array(F.struct(begin.alias("start"), F.length(t["body"]).alias("length"))))
            ).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return ordered.select(
        "tree", "leaf", "rank", "score",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(f"{END}\n")))).alias("text"),
        F.aggregate("turns", start, advance)["spans"].alias("loss_spans"),
    )


def parsed(text: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 1 << 30)
        at = F.instr(body, F.lit("\n"))
        return F.struct(
            unescaped_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substring(body, at + 1, F.length(body))).alias("text"),
        )

    return F.transform(pieces, turn)


def learned(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))))
