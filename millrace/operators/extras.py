"""Probabilities from counts, moving indicators, nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def probability(event: Column) -> Column:
    """Occurrences / trials."""
    return F.avg(F.when(event, 1.0).otherwise(0.0))


def posterior(df: DataFrame, keys: list[str], event: Column, condition: Column) -> DataFrame:
    """prior, likelihood, evidence and posterior of an event under a condition, by group."""
    n, both = F.count("*"), F.count_if(event & condition)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.groupBy(*keys).agg(probability(event).alias("prior"), ratio(both, F.count_if(event)).alias("likelihood"), (F.count_if(condition) / n).alias("evidence"), ratio(both, F.count_if(condition)).alias("posterior"))


def sum_rule(a: Column, b: Column) -> Column:
    """P(a or b)."""
    return probability(a | b)


def product_rule(a: Column, b: Column) -> Column:
    """P(a) P(b | a)."""
    return probability(a) * F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(a)), F.lit(0.0))


def moving_average(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Mean over the last n rows, the row included; missing until n rows are there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = w.rowsBetween(-(n - 1), 0)
    return F.when(F.row_number().over(w) >= n, F.avg(value).over(rows))


def relative_strength(df: DataFrame, value: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Adds rsi: 100 - 100 / (1 + gains / losses) over the last n changes, 100 without losses; missing before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("d", F.col(value) - F.lag(value).over(w)).withColumn("nr", F.row_number().over(w))
    rows = w.rowsBetween(-(n - 1), 0)
    gain, loss = F.sum(F.greatest("d", F.lit(0.0))).over(rows), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).over(rows)
    d = d.withColumn("gain", gain).withColumn("loss", loss)
    rsi = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return d.withColumn("rsi", F.when(F.col("nr") > n, rsi)).drop("d", "nr", "gain", "loss")


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_block: int = 1024, row_block: int = 8192) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): exact k nearest rows of every query, rows with the query's own id left out.

    Queries and rows are dealt into blocks; each block of queries meets each block of rows in one group, which keeps the k best of a query.
    """
    r = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null")
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null").distinct()
    n_q, n_r = max(1, -(-q.count() // query_block)), max(1, -(-r.count() // row_block))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", dealt(n_q)).withColumn("rb", all_of(n_r)).groupBy("qb", "rb")
    right = r.withColumn("rb", dealt(n_r)).withColumn("qb", all_of(n_q)).groupBy("qb", "rb")

    def best(a, b):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        matrix = lambda t: np.stack(t.column("x").combine_chunks().to_numpy(zero_copy_only=False))
        ids, node, x = a.column("id").to_numpy(), b.column("id").to_numpy(), matrix(b)
        out = []
        for qi, v in zip(ids, matrix(a), strict=True):
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            own = np.flatnonzero(node != qi)
            if len(own) > k:  # all that tie with the k-th stay for the order by id
                own = own[d[own] <= np.partition(d[own], k - 1)[k - 1]]
            own = own[np.lexsort((node[own], d[own]))[:k]]
            out.append((np.full(len(own), qi), node[own], d[own]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    found = left.cogroup(right).applyInArrow(best, "query_id long, neighbor_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
