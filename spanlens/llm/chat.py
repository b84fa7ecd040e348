"""Reply trees: paths from root to leaf by self-joins, branches ranked by score, each chosen path one formatted conversation."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.common import fresh, staged

OPEN, CLOSE = "### ", " </turn>\n"
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"(?:\\.|[^\\:])*", re.DOTALL)


def escape(text: str) -> str:
    """Reversible: no ``##`` and no ``</turn>`` is left, a backslash is doubled."""
    text = text.replace("\\", "\\\\")
    return re.sub(r"#(?=#)", "#\\\\", text).replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """One conversation and the spans (code points, end exclusive) of the texts to learn: those of role ``learned``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of ``format_turns``."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        role = _ROLE.match(formatted, at + len(OPEN))
        start = role.end() + 2
        end = formatted.index(CLOSE, start)
        turns.append((unescape(role[0]), unescape(formatted[start:end])))
        at = end + len(CLOSE)
    return turns


def read_learned(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, as it was before escaping."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tree, node, up) by powers of two: the 2^k-th ancestors; and the root distance and path score of each node.

    ``nodes`` has tree, node, parent (null or unknown: a root), score. Step k looks the ancestors of the nodes
    that have one up in the same table, so a path of n turns takes log2(n) joins, no row is wider than a few ids,
    and nodes nearer than 2^k to their root take no part. Nodes on or behind a cycle never meet a root and are
    left out of the second table.
    """
    known = nodes.select("tree", F.col("node").alias("parent")).withColumn("there", F.lit(True))
    first = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("depth"), F.col("score").alias("total")
    )
    here = staged(first, "ancestors")
    open_, placed = here.where("up IS NOT NULL"), here.where("up IS NULL")
    levels = []
    steps = max(1, nodes.count()).bit_length()
    while len(levels) <= steps and not open_.isEmpty():
        levels.append(open_.select("tree", "node", "up"))
        above = placed.unionByName(open_).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        joined = open_.join(above, ["tree", "up"])
        here = staged(joined.select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total")), "ancestors")
        open_, placed = here.where("up IS NOT NULL"), placed.unionByName(here.where("up IS NULL"))
    return levels, placed.select("tree", "node", "depth", "total")


def chosen_paths(nodes: DataFrame, keep: int) -> DataFrame:
    """tree, leaf, branch (1: best), node, depth of every node on the ``keep`` best root-to-leaf paths of each tree.

    Branches are ranked by the sum of their scores, ties to the shorter and then to the smaller leaf. A path's
    nodes are gathered by doubling: with the ancestors at distances below 2^k known, the 2^k-th ancestors of
    all of them add as many again.
    """
    levels, placed = ancestors(nodes)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct() if levels else nodes.select("tree", "node").limit(0)
    leaves = placed.join(parents, ["tree", "node"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), "depth", "node")
    best = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= keep)
    paths = staged(best.select("tree", F.col("node").alias("leaf"), "branch", "node"), "paths")
    for level in levels:
        added = paths.join(level, ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"))
        paths = paths.unionByName(staged(added, "paths"))
    return paths.join(placed.select("tree", "node", "depth"), ["tree", "node"])


FORMATTED = "struct<formatted:string,spans:array<struct<start:bigint,end:bigint>>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatter(learned: str):
    @F.arrow_udf(FORMATTED)
    def write(turns: pa.Array) -> pa.Array:
        out = []
        for row in turns.to_pylist():
            text, spans = format_turns([(t["role"] or "", t["text"] or "") for t in row], learned)
            out.append({"formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(out, pa.struct([("formatted", pa.string()), ("spans", SPANS)]))

    return write


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text", score: Column | None = None, keep: int = 1, learned: str = "assistant") -> DataFrame:
    """tree, leaf, branch, n_turns, formatted, spans: one row for each of the ``keep`` best paths of each tree.

    ``spans`` are the places (code points) of the texts of role ``learned``, the loss mask. Only ids and scores
    take part in the joins that build the paths; roles and texts join the chosen nodes once at the end.

    Null texts and roles count as empty, null scores as 0. A null or unknown parent makes a root; a tree may
    have several. Rows with null tree are one tree. A node id that a tree holds twice keeps one row, the one
    whose role and text come first; rows with null node cannot be replied to and are left out. Messages on or
    behind a cycle have no root and are left out. Other columns are not read.
    """
    value = F.lit(0.0) if score is None else F.coalesce(score.cast("double"), F.lit(0.0))
    own = messages.select(F.struct(F.col(f"`{tree}`").alias("id")).alias("tree"), F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("parent"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), value.alias("score")).where("node IS NOT NULL")
    own = own.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
    own = staged(own.select("tree", "node", "m.*"), "messages")
    paths = chosen_paths(own.select("tree", "node", "parent", "score"), keep)
    full = paths.join(own.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = full.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    made = turns.select("tree", "leaf", "branch", F.size("turns").cast("bigint").alias("n_turns"), _formatter(learned)("turns").alias("f"))
    return made.select(F.col("tree.id").alias(tree), "leaf", "branch", "n_turns", "f.formatted", "f.spans")


def linear(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations without branches as reply trees: each row answers the one before, by turn; ties by role and text, null turns last.

    Adds the columns ``node`` and ``parent`` (or free names derived from them, see ``fresh``).
    """
    node = fresh(rows, "node")
    order = Window.partitionBy(f"`{tree}`").orderBy(F.col(f"`{turn}`").asc_nulls_last(), "role", "text")
    numbered = rows.withColumn(node, F.row_number().over(order).cast("bigint"))
    return numbered.withColumn(fresh(numbered, "parent"), F.col(node) - 1)
