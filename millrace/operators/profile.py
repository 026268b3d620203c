"""Profiles of tables: shape, types, describe, duplicates, mode, categories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shape_and_missing(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, and the non-missing count of each column, in one scan."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), *[F.count(c).alias(f"n_{c}") for c in df.columns])


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, column string, type string")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def at_ranks(df: DataFrame, wanted: dict[str, tuple[list[int], float, float]], bins: int = 4096) -> dict[tuple[str, int], float]:
    """The present values of columns at 0-based ranks; wanted: ranks, least and largest value of each column.

    Counts by bin tell where a rank lies, and that bin is looked at more closely, until it holds one value. A pass is one job for all columns and sends at most `bins` rows
    per rank to the driver, whatever the size of the table.
    """
    spans = {(c, r): (low, high, 0) for c, (ranks, low, high) in wanted.items() for r in ranks}
    out: dict[tuple[str, int], float] = {}
    while True:
        for key in [k for k, (a, b, _) in spans.items() if a == b]:
            out[key] = spans.pop(key)[0]
        if not spans:
            return out
        todo, cells = sorted({(c, *span) for (c, _), span in spans.items()}), []
        for i, (c, a, b, _) in enumerate(todo):
            x = F.col(c).cast("double")
            bin_ = F.least(F.floor((x - a) / (b - a) * bins), F.lit(bins - 1))
            cells.append(F.struct(F.lit(i).alias("i"), F.when(x.between(a, b), bin_).alias("bin"), x.alias("x")))
        long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("bin is not null")
        rows = long.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("i", "bin").collect()
        for (c, r), span in list(spans.items()):
            before = span[2]
            for row in (x for x in rows if todo[x["i"]] == (c, *span)):
                if r < before + row["n"]:
                    spans[c, r] = (row["a"], row["b"], before)
                    break
                before += row["n"]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, mean, std (sample), low, q25, q50, q75, high of numeric columns: one scan for all, and a few more for the exact quartiles of all."""
    columns = columns or numeric_columns(df)
    parts = [f(F.col(c).cast("double")) for c in columns for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    r = df.agg(*parts).first()
    of = {c: r[5 * i : 5 * i + 5] for i, c in enumerate(columns)}
    places = {c: [q * (x[0] - 1) for q in (0.25, 0.5, 0.75)] for c, x in of.items() if x[0]}
    found = at_ranks(df, {c: (sorted({k for x in p for k in (math.floor(x), math.ceil(x))}), of[c][3], of[c][4]) for c, p in places.items()})
    rows = []
    for c, (n, mean, std, low, high) in of.items():
        between = lambda x, c=c: found[c, math.floor(x)] + (x - math.floor(x)) * (found[c, math.ceil(x)] - found[c, math.floor(x)])
        rows.append((c, n, mean, std, low, *([between(x) for x in places[c]] if n else [None] * 3), high))
    return df.sparkSession.createDataFrame(rows, "column string, n long, mean double, std double, low double, q25 double, q50 double, q75 double, high double")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row; missing equals missing."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value by group, the smallest on ties: counts first, so a hot group is summed before the shuffle."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    return counts.groupBy(*keys).agg(F.max(F.struct("count", (-F.col(column)).alias("v"))).alias("m")).select(*keys, (-F.col("m.v")).alias("mode"))


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the distinct non-missing values of several columns in one job."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s"))
    return long.select("s.*").where("value is not null").distinct()


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)
