"""Undirected graphs as edge tables (u, v), and searches as joins of a frontier.

Each level of a search is written to the shared folder, so the plan of a level doesn't hold those of the levels before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import discard, settled


def add_nodes(nodes: DataFrame, new: DataFrame, last_id: int = 0) -> DataFrame:
    """Nodes (node_id, data) with rows of `new` (data) added under running ids after `last_id`, in the order of their data.

    Ids come from counts by partition of the sorted rows: only counts meet in one place. An id that is there already takes the new row's data, as ids run on from
    the counter and not from the nodes.
    """
    part, at = F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")
    rows = settled(new.select("data").sort("data").select("data", part, at), "nodes")
    counts = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    counts = counts.select("p", "first", before.alias("before"))
    added = rows.join(F.broadcast(counts), "p").select((F.lit(last_id) + F.col("before") + F.col("at") - F.col("first") + 1).cast("long").alias("node_id"), "data")
    return nodes.select("node_id", "data").join(added.select("node_id"), "node_id", "left_anti").unionByName(added)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbor) in both directions, each once."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("neighbor")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("neighbor"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, the lower end first (export form)."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def edge_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, error) of edges with an unknown end, and of edges that repeat in the same orientation."""
    n = nodes.select("node_id")
    unknown = edges.join(n, F.col("u") == F.col("node_id"), "left_anti").union(edges.join(n, F.col("v") == F.col("node_id"), "left_anti")).distinct()
    twice = edges.groupBy("u", "v").count().where("count > 1").select("u", "v")
    return unknown.withColumn("error", F.lit("unknown node")).unionByName(twice.withColumn("error", F.lit("duplicate")))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Checked union; any error is raised."""
    both = edges.select("u", "v").unionByName(new.select("u", "v"))
    if bad := edge_errors(nodes, both).limit(1).collect():
        raise ValueError(f"edge {bad[0]['u']}-{bad[0]['v']}: {bad[0]['error']}")
    return both


def remove_node(nodes: DataFrame, edges: DataFrame, node_id: int) -> tuple[DataFrame, DataFrame]:
    """The graph without a node and its edges."""
    return nodes.where(F.col("node_id") != node_id), edges.where((F.col("u") != node_id) & (F.col("v") != node_id))


@dataclass(frozen=True)
class SearchContext:
    """start, a target predicate on nodes, bounds, and whether nodes may be met again."""

    start: int
    target: Column | None = None
    max_depth: int | None = None
    allow_revisiting: bool = False
    metadata: dict = field(default_factory=dict)


def check(nodes: DataFrame, context: SearchContext) -> None:
    if context.target is None and context.max_depth is None:
        raise KeyError("a search needs a target or a depth")
    if nodes.where(F.col("node_id") == context.start).isEmpty():
        raise KeyError(f"no node {context.start}")


def frontiers(nodes: DataFrame, edges: DataFrame, context: SearchContext, most_levels: int, depth_first: bool = False) -> DataFrame:
    """(level, path, node): one join with the adjacency a level, until nothing is new or a target has come."""
    near = settled(adjacency(edges), "adjacency")
    targets = nodes.where(context.target).select(F.col("node_id").alias("node")) if context.target is not None else None
    now = nodes.where(F.col("node_id") == context.start).select(F.lit(0).alias("level"), F.array("node_id").alias("path"), F.col("node_id").alias("node")).distinct()
    parts: list[DataFrame] = []
    levels = most_levels if context.max_depth is None else min(most_levels, context.max_depth)
    for level in range(levels + 1):
        now = settled(now, "frontier")
        if now.isEmpty():
            break
        parts.append(now)
        if targets is not None and not depth_first and not now.join(targets, "node", "left_semi").isEmpty():
            break
        step = now.join(near, "node").select(F.lit(level + 1).alias("level"), F.concat("path", F.array("neighbor")).alias("path"), F.col("neighbor").alias("node"))
        if depth_first:
            now = step.where(~F.array_contains(F.slice("path", 1, F.size("path") - 1), F.col("node")))
        elif not context.allow_revisiting:
            # neighbours of a level are in it, in the one before or in the next: no other node can have been met
            fresh = step
            for met in parts[-2:]:
                fresh = fresh.join(met.select("node"), "node", "left_anti")
            now = fresh.groupBy("node").agg(F.min("path").alias("path"), F.min("level").alias("level")).select("level", "path", "node")
        else:
            now = step
    discard(near)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(found: DataFrame, nodes: DataFrame, context: SearchContext, keys: list[str]) -> DataFrame:
    """(step, level, node, path) in search order, ending with the first target. The result is a walk, ranked as a whole."""
    out = found.withColumn("step", F.row_number().over(Window.orderBy(*keys)))
    if context.target is not None:
        hits = out.join(nodes.where(context.target).select(F.col("node_id").alias("node")), "node", "left_semi").agg(F.min("step").alias("last"))
        out = out.join(F.broadcast(hits)).where("last is null or step <= last").drop("last")
    return out.select(F.col("step").cast("long"), "level", "node", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


def bfs(nodes: DataFrame, edges: DataFrame, context: SearchContext, most_levels: int = 50, evaluator: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Breadth-first: by level, then by path, neighbours ascending; without revisits each node at its first arrival."""
    check(nodes, context)
    out = ordered(frontiers(nodes, edges, context, most_levels), nodes, context, ["level", "path"])
    if evaluator is not None:
        (evaluator.evaluate if hasattr(evaluator, "evaluate") else evaluator)(out)
    return out


def dfs(nodes: DataFrame, edges: DataFrame, context: SearchContext, most_levels: int = 50) -> DataFrame:
    """Preorder over simple paths: by path alone; exact on trees, where each node has one path."""
    check(nodes, context)
    found = frontiers(nodes, edges, context, most_levels, depth_first=True)
    first = found.groupBy("node").agg(F.min("path").alias("path")).withColumn("level", F.size("path") - 1)
    return ordered(first, nodes, context, ["path"])
