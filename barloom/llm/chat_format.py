"""Chat formatting of reply trees.

Messages point at the message they reply to. Jump pointers (1, 2, 4, ... replies up) come from
joining the pointer table with itself; from every leaf, the pointers taken from the longest to the
shortest reach each message of its path exactly once. Branches of a tree are ranked by the sum of
their scores, and each chosen path becomes one formatted conversation with its loss mask.

Defined cases: a null text or role is the empty text; a parent that is null or missing makes a
root; of rows repeated with one node id the smallest (parent, role, text, score) counts; null tree
ids form one tree; ties between branches go to the smaller leaf; messages on a reply cycle, or
below one, have no root and are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import key_of, stored, text_of

# The marks of the template.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"

_MARK = r"/?(?:s>|INST\]|SYS\]|ROLE\]|TURN\])"
_OPENING = r"(?s)\A(?:\[ROLE\].*?\[/ROLE\]|\[SYS\]|\[INST\]|<s>)"
_CLOSING = r"(?:\[/TURN\]|\[/SYS\]|\[/INST\]|</s>)"
_TURN = r"(?s)(?:\[ROLE\]|\[SYS\]|\[INST\]|<s>).*?" + _CLOSING


def escape(text: Column) -> Column:
    r"""No mark of the template is left in the text: ``<s>`` becomes ``<\s>``, ``<\s>`` ``<\\s>``."""
    return F.regexp_replace(text, r"([<\[])(\\*)(" + _MARK + ")", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\(" + _MARK + ")", "$1$2")


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    found = other
    for name, mark in marks.items():
        found = F.when(role == name, F.lit(mark)).otherwise(found)
    return found


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from one formatted conversation."""

    def turn(raw: Column) -> Column:
        named = F.regexp_extract(raw, r"(?s)\A\[ROLE\](.*?)\[/ROLE\]", 1)
        role = unescape(named)
        for name, mark in OPEN.items():
            role = F.when(F.startswith(raw, F.lit(mark)), F.lit(name)).otherwise(role)
        body = F.regexp_replace(F.regexp_replace(raw, _OPENING, ""), _CLOSING + r"\z", "")
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def learnt_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after the other."""

    def body(span: Column) -> Column:
        start = (span["start"] + 1).cast("int")
        return unescape(F.substr(formatted, start, span["length"].cast("int")))

    return F.array_join(F.transform(spans, body), "")


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """(tree, node, up): the i-th table leads 2**i replies up, where there are so many."""
    there = nodes.select("tree", F.col("node").alias("up"))
    first = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("up"))
    tables = [stored(first.join(there, ["tree", "up"], "left_semi"), "replies-0")]
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # a path is never longer than its tree; what still points up then runs in a circle
    while len(tables) <= largest.bit_length() and not tables[-1].isEmpty():
        low = tables[-1]
        high = low.select("tree", F.col("node").alias("up"), F.col("up").alias("higher"))
        tables.append(
            stored(
                low.join(high, ["tree", "up"]).select("tree", "node", F.col("higher").alias("up")),
                f"replies-{len(tables)}",
            )
        )
    return tables


def _paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, height) for every message on every root-to-leaf path."""
    jumps = _jumps(nodes)
    replied = jumps[0].select("tree", F.col("up").alias("node"))
    circling = jumps[-1].select("tree", "node")
    leaves = (
        nodes.select("tree", "node")
        .join(replied, ["tree", "node"], "left_anti")
        .join(circling, ["tree", "node"], "left_anti")
    )
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("height"))
    for i, jump in reversed(list(enumerate(jumps[:-1]))):
        paths = stored(paths, "paths")
        higher = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), F.col("height") + F.lit(1 << i)
        )
        paths = paths.unionAll(higher)
    return paths


def format_replies(
    messages: DataFrame,
    *,
    tree: str,
    node: str,
    parent: str,
    role: str = "role",
    text: str = "text",
    score: Column | None = None,
    branches: int | None = 1,
) -> DataFrame:
    """One row per chosen branch: its tree, leaf, score, rank, turns, text and loss mask.

    ``branches`` is the number of branches taken per tree, best score first (all
    if None). ``loss_spans`` has start and length, in code points of
    ``formatted``, of the body of each assistant turn.
    """
    rows = messages.select(
        F.col(f"`{tree}`").alias("tree_id"),
        key_of(F.col(f"`{tree}`")).alias("tree"),
        F.col(f"`{node}`").alias("node"),
        F.struct(
            F.col(f"`{parent}`").alias("parent"),
            text_of(F.col(f"`{role}`")).alias("role"),
            text_of(F.col(f"`{text}`")).alias("text"),
            F.coalesce(
                F.lit(0.0) if score is None else score.cast("double"), F.lit(0.0)
            ).alias("score"),
        ).alias("said"),
    ).where(F.col("node").isNotNull())
    nodes = stored(
        rows.groupBy("tree", "tree_id", "node")
        .agg(F.min("said").alias("said"))
        .select("tree", "tree_id", "node", "said.*"),
        "messages",
    )
    on_path = _paths(nodes.select("tree", "node", "parent")).join(nodes, ["tree", "node"])
    role_, body = F.col("role"), escape(F.col("text"))
    named = F.concat(F.lit(OTHER_OPEN), escape(role_), F.lit(OTHER_NAMED))
    on_path = on_path.select(
        "tree", "tree_id", "leaf", "height", "score",
        (role_ == "assistant").alias("learnt"),
        F.length(_by_role(role_, OPEN, named)).alias("opening"),
        F.length(body).alias("body"),
        F.concat(
            _by_role(role_, OPEN, named), body, _by_role(role_, CLOSE, F.lit(OTHER_CLOSE))
        ).alias("turn"),
    )
    before = (
        Window.partitionBy("tree", "tree_id", "leaf")
        .orderBy(F.desc("height"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("opening")
    found = (
        on_path.withColumn("start", start)
        .groupBy("tree", "tree_id", "leaf")
        .agg(
            F.sum("score").alias("score"),
            F.count(F.lit(1)).alias("n_turns"),
            F.array_sort(
                F.collect_list(F.struct(-F.col("height"), "turn", "learnt", "start", "body"))
            ).alias("turns"),
        )
    )
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    found = found.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        found = found.where(F.col("rank") <= branches)
    spans = F.transform(
        F.filter("turns", lambda t: t["learnt"]),
        lambda t: F.struct(t["start"].alias("start"), t["body"].cast("long").alias("length")),
    )
    return found.select(
        F.col("tree_id").alias(tree),
        "leaf", "rank", "score", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def chained(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as reply trees: each row replies to the one before it by turn.

    The whole conversation becomes one output row, so numbering it in one group
    gathers no more than the result does.
    """
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    numbered = rows.select(tree, role, text, F.row_number().over(order).alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
