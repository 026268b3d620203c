"""Connected components of links, by stars that are rewired until every vertex points at the least of its component."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def star(pairs: DataFrame, large: bool) -> DataFrame:
    """One pass over (u, v): the larger (large) or the smaller neighbours of each vertex are tied to the least of its neighbourhood."""
    around = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")).where("u <> v")).distinct()


def at_once(now: DataFrame) -> DataFrame:
    """(id, component_id) of few links, in one task."""
    schema = pa.schema([("id", pa.int64()), ("component_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], schema=schema)

    return now.repartition(1).mapInArrow(run, "id long, component_id long")


def components(links: DataFrame, most_rounds: int = 40, most_links: int = 1 << 20) -> DataFrame:
    """(id, component_id) for each end of the links (u, v); the component is its least id. Ends that are null or equal are no links.

    Up to `most_links` different links are joined up in one task, which holds them all; more are rewired over many. A hub's links are many rows of one key: these are
    only aggregated (with partial sums) and joined to one row, which adaptive execution splits.
    """
    now = materialize(links.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "links")
    if now.count() <= most_links:
        return materialize(at_once(now), "components")
    mark, old = None, None
    for _ in range(most_rounds):
        new = materialize(star(star(now, True), False), "links")
        drop(now)
        now, old = new, mark
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == old:
            return now.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id").union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
    raise RuntimeError("components did not settle")
