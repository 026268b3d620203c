"""Vector expressions over scalar columns; all stay within generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_score(features: list[str | Column], weights: list[float], bias: float) -> Column:
    """w.x + b."""
    terms = [F.lit(float(w)) * (F.col(x) if isinstance(x, str) else x) for x, w in zip(features, weights, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0)) + F.lit(float(bias))


def sign_class(features: list[str | Column], weights: list[float], bias: float) -> Column:
    """Sign of the score: -1, 0 or 1 as a double."""
    return F.signum(linear_score(features, weights, bias)).cast("double")


def expand(features: list[str], degree: int) -> list[Column]:
    """Powers 1 to degree of each feature, feature by feature; no cross terms, no constant. Degree 1 is the identity."""
    return [F.pow(F.col(x).cast("double"), F.lit(float(k))).alias(x if k == 1 else f"{x}_{k}") for x in features for k in range(1, degree + 1)]


def expand_weights(weights: list[float], degree: int) -> list[float]:
    return [w**k for w in weights for k in range(1, degree + 1)]


def array_score(weights: str | Column, features: str | Column, bias: Column) -> Column:
    """The score of array columns."""
    return F.aggregate(F.zip_with(weights, features, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + bias


def diagonal_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, i, j, q): the diagonal matrix of squares of an array column, as its non-zero places."""
    at = df.select(*keys, F.posexplode(vector).alias("i", "v"))
    return at.select(*keys, F.col("i"), F.col("i").alias("j"), (F.col("v") * F.col("v")).alias("q"))


def gradient_sums(features: list[str], g: Column) -> list[Column]:
    """X'g and the sum of g, for one aggregate."""
    return [F.sum(F.col(x) * g).alias(f"g_{i}") for i, x in enumerate(features)] + [F.sum(g).alias("g_bias")]
