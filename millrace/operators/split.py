"""Deterministic splits of exact size, seeded weights, parameter grids."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A multiplicative hash modulo 2^32 that any engine with 64-bit integers computes alike.
MULTIPLIER, MODULUS = 2_654_435_761, 1 << 32
BINS = 1 << 14


def split_hash(key: str, salt: int = 0) -> Column:
    return F.pmod(F.pmod(F.col(key) + salt, F.lit(MODULUS)) * F.lit(MULTIPLIER % MODULUS) % F.lit(MODULUS), F.lit(MODULUS))


def train_test(df: DataFrame, key: str, share: float = 0.2, salt: int = 0) -> DataFrame:
    """Adds is_test: the ceil(share x n) rows with the smallest (hash, key).

    A histogram of hashes finds the bin where the cut lies; only rows of this bin are ranked, so no single task sorts the table.
    """
    df = df.withColumn("h", split_hash(key, salt)).withColumn("bin", F.floor(F.col("h") * BINS / MODULUS))
    counts = sorted((r["bin"], r["count"]) for r in df.groupBy("bin").count().collect())
    wanted = math.ceil(share * sum(n for _, n in counts))
    before, cut = 0, -1
    for b, n in counts:
        cut = b
        if before + n >= wanted:
            break
        before += n
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h", key))
    inside = df.where(F.col("bin") == cut).withColumn("is_test", rank <= wanted - before)
    outside = df.where(F.col("bin") != cut).withColumn("is_test", F.col("bin") < cut)
    return outside.unionByName(inside).drop("h", "bin")


def seeded_weights(k: int, seed: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    """Uniform start weights of the PCG64 generator, on the driver."""
    return (np.random.default_rng(seed).random(k) * (high - low) + low).tolist()


def grid_runs(grid: dict[str, list]) -> list[dict]:
    """The Cartesian product, keys by name, the last key fastest; `run` counts from 1."""
    keys = sorted(grid)
    return [{"run": i, **dict(zip(keys, values, strict=True))} for i, values in enumerate(product(*(grid[k] for k in keys)), 1)]


def grid_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """The same as a small frame."""
    kinds = {str: "string", float: "double", int: "bigint"}
    keys = sorted(grid)
    schema = ", ".join(["run bigint", *[f"{k} {kinds[type(grid[k][0])]}" for k in keys]])
    return spark.createDataFrame([(r["run"], *[r[k] for k in keys]) for r in grid_runs(grid)], schema)
