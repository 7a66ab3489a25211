"""Reply trees written as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, let

#: The marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One backslash more between a < and the | behind it, so that no mark can stand in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _ancestors(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Distance and summed score from the root for each node that has one, and jump tables to the ancestor 2^k above.

    Pointer doubling: round k joins the nodes that lie deeper than 2^k with the table, so a path of n turns takes
    log2(n) rounds. A parent that isn't
    there makes its node a root. Nodes on a cycle, or below one, never reach a root.
    """
    there = nodes.select(F.col("__tree"), F.col("__node").alias("__up"))
    edges = nodes.select("__tree", "__node", "__parent", "__score")
    state = edges.join(there.withColumn("__there", F.lit(True)), (edges["__tree"] == there["__tree"]) & (edges["__parent"] == there["__up"]), "left")
    state = state.select(edges["__tree"], edges["__node"], F.when(F.col("__there"), F.col("__parent")).alias("__up"), F.when(F.col("__there"), 1).otherwise(0).cast("long").alias("__depth"), F.col("__score").alias("__sum"))
    jumps, unresolved, k = [], -1, 0
    while True:
        state = scratch.keep(f"jump{k}", state)
        jumps.append(state.where("__up IS NOT NULL").select("__tree", "__node", "__up"))
        if (now := jumps[-1].count()) in (0, unresolved):
            return state.where("__up IS NULL"), jumps
        unresolved, k = now, k + 1
        a, b = state.where("__up IS NOT NULL").alias("a"), state.alias("b")
        moved = a.join(b, (F.col("a.__tree") == F.col("b.__tree")) & (F.col("a.__up") == F.col("b.__node"))).select(
            "a.__tree", "a.__node", F.col("b.__up").alias("__up"), (F.col("a.__depth") + F.col("b.__depth")).alias("__depth"), (F.col("a.__sum") + F.col("b.__sum")).alias("__sum")
        )
        state = state.where("__up IS NULL").unionByName(moved)


def format_paths(
    messages: DataFrame, *, tree: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text",
    score: str | None = None, branches: int | None = None, learned: str = "assistant",
) -> DataFrame:
    """One row for each chosen root-to-leaf path of each reply tree.

    ``messages`` has a row for each message: its tree, its node (unique in the tree), its parent (null for a root), its
    role, text and score. A path ends at a node without replies; its score is the mean of its messages'. Paths of a tree
    are ranked by score, ties by the leaf's node, and the first ``branches`` are chosen (None: all). Returns ``tree``,
    ``leaf``, ``rank``, ``path_score``, ``n_turns``, ``formatted`` and ``loss_spans``: the code points [start, end) of
    ``formatted`` that hold the escaped texts of role ``learned``, with nothing else.

    Turns read OPEN role newline text CLOSE newline; roles are URL-encoded and texts escaped (see ``escape``), so that
    ``read_turns`` gives back what went in. Only ids are joined in the self-joins; texts meet the chosen paths once.

    Null roles and texts are empty, null scores 0. Rows with a null tree are one tree. Rows with a null node are left out,
    and so are nodes whose parents run in a circle: they have no root. Repeated rows of one node are one node, the one with
    the least role and text. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.where(F.col(node).isNotNull()).select(
        _key(tree).alias("__tree"), F.col(tree).alias("__name"), F.col(node).cast("string").alias("__node"), F.col(parent).cast("string").alias("__parent"), value.alias("__score"),
        F.coalesce(role, F.lit("")).alias("__role"), F.coalesce(text, F.lit("")).alias("__text"),
    )
    rows = rows.groupBy("__tree", "__node").agg(F.min(F.struct("__role", "__text", "__parent", "__score", "__name")).alias("m")).select("__tree", "__node", "m.*")
    rows = scratch.keep("messages", rows)

    rooted, jumps = _ancestors(scratch, rows)
    replied = rows.select("__tree", F.col("__parent").alias("__node")).where("__node IS NOT NULL").distinct()
    leaves = rooted.join(replied, ["__tree", "__node"], "left_anti").withColumn("__mean", F.col("__sum") / (F.col("__depth") + 1))
    best = Window.partitionBy("__tree").orderBy(F.desc("__mean"), F.length("__node"), "__node")
    leaves = leaves.withColumn("__rank", F.row_number().over(best).cast("long"))
    leaves = leaves.where(F.col("__rank") <= branches) if branches else leaves
    leaves = scratch.keep("leaves", leaves.select("__tree", F.col("__node").alias("__leaf"), "__rank", "__mean"))

    reached = leaves.select("__tree", "__leaf", F.col("__leaf").alias("__node"))
    for k, jump in reversed(list(enumerate(jumps))):
        step = reached.join(jump, ["__tree", "__node"]).select("__tree", "__leaf", F.col("__up").alias("__node"))
        reached = scratch.keep(f"reached{k}", reached.unionByName(step))  # it stands twice in the next round's plan

    turns = reached.join(rooted.select("__tree", "__node", "__depth"), ["__tree", "__node"]).join(rows.select("__tree", "__node", "__name", "__role", "__text"), ["__tree", "__node"])
    head = F.concat(F.lit(OPEN), F.url_encode("__role"), F.lit("\n"))
    body = escape(F.col("__text"))
    turns = turns.select("__tree", "__leaf", "__name", F.struct("__depth", (F.col("__role") == learned).alias("learned"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(CLOSE + "\n")).alias("turn")).alias("t"))
    paths = turns.groupBy("__tree", "__leaf").agg(F.min("__name").alias("__name"), F.array_sort(F.collect_list("t")).alias("ts"))
    close = len(CLOSE) + 1
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = (s["at"] + t["head"]).cast("long")
        end = (start + t["body"]).cast("long")
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + close).cast("long").alias("at"), F.when(t["learned"], F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("ts", zero, add, lambda s: s["spans"])
    paths = paths.select("__tree", "__leaf", "__name", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))
    return paths.join(leaves, ["__tree", "__leaf"]).select(
        F.col("__name").alias(tree), F.col("__leaf").alias("leaf"), F.col("__rank").alias("rank"), F.col("__mean").alias("path_score"), "n_turns", "formatted", "loss_spans"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    inner = F.split(formatted, r"<\|im_start\|>")
    marked = F.filter(inner, lambda t: t != "")

    def turn(t: Column) -> Column:
        at = F.instr(t, "\n")
        text = t.substr(at + 1, F.length(t) - at - len(CLOSE) - 1)
        return F.struct(F.url_decode(t.substr(F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
