"""Rooted trees as links (node_id, parent_id, position): each node has at most one parent, children have an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def add_children(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with rows of new (node_id, parent_id, position) appended after each parent's children, in the order of their own positions; a node that has a place loses it."""
    last = links.where("parent_id is not null").groupBy("parent_id").agg(F.max("position").alias("last"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("position", "node_id"))
    added = new.withColumn("rank", rank).join(last, "parent_id", "left")
    added = added.select("node_id", "parent_id", (F.coalesce("last", F.lit(0)) + F.col("rank")).cast("long").alias("position"))
    kept = links.join(added.select("node_id"), "node_id", "left_anti").select("node_id", "parent_id", "position")
    return kept.unionByName(added)


def remove_children(links: DataFrame, removed: DataFrame) -> DataFrame:
    """links in which the nodes of `removed` (node_id) have no parent any more; what hangs below them stays."""
    gone = removed.select("node_id", F.lit(True).alias("gone")).distinct()
    d = links.join(gone, "node_id", "left")
    keep = lambda c: F.when(F.col("gone").isNull(), F.col(c)).alias(c)
    return d.select("node_id", keep("parent_id"), keep("position"))


def children(links: DataFrame) -> DataFrame:
    """(parent_id, n_children, children) of nodes with children: their ids in order, as a text."""
    own = F.sort_array(F.collect_list(F.struct("position", "node_id")))
    ids = F.concat_ws("-", F.transform(own, lambda x: x["node_id"].cast("string")))
    return links.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"), ids.alias("children"))
