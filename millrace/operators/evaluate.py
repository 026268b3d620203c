"""Confusion counts and measures, run logs, best runs.

`compat` names follow the engine's users: "fp" counts actual 1 predicted otherwise, "fn" actual 0 predicted otherwise, so precision and recall
trade places. `standard` uses the usual names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import Model


def counts(actual: Column, predicted: Column, compat: bool = True) -> list[Column]:
    """Aggregates n, correct, tp, fp, tn, fn; null predictions match nothing."""
    missed = F.count_if((actual == 1) & ~predicted.eqNullSafe(F.lit(1)))
    alarm = F.count_if((actual == 0) & ~predicted.eqNullSafe(F.lit(0)))
    fp, fn = (missed, alarm) if compat else (alarm, missed)
    return [F.count("*").alias("n"), F.count_if(actual.eqNullSafe(predicted)).alias("correct"), F.count_if((actual == 1) & (predicted == 1)).alias("tp"), fp.alias("fp"), F.count_if((actual == 0) & (predicted == 0)).alias("tn"), fn.alias("fn")]


def ratio(a: str, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.col(a) / b)


def with_measures(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall from the counts; a zero denominator gives 0."""
    return df.withColumn("accuracy", ratio("correct", F.col("n"))).withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))


def confusion(df: DataFrame, actual: str, predicted: str, compat: bool = True) -> DataFrame:
    return with_measures(df.agg(*counts(F.col(actual), F.col(predicted), compat)))


def error_rate(actual: str, predicted: str) -> Column:
    return F.avg(F.when(F.col(actual) != F.col(predicted), 1.0).otherwise(0.0))


def run_log(df: DataFrame, features: list[str], label: str, models: dict[int, Model]) -> DataFrame:
    """(run, n, correct, tp, fp, tn, fn, accuracy, precision, recall) of many models: one scan, -1 read as 0."""
    runs = sorted(models)
    structs = []
    for r in runs:
        p = models[r].predict(features)
        p = F.when(p == -1, 0.0).otherwise(p)
        structs.append(F.struct(F.lit(r).cast("long").alias("run"), *counts(F.col(label), p)))
    wide = df.agg(F.array(*structs).alias("all"))
    return with_measures(wide.select(F.explode("all").alias("s")).select("s.*"))


def best_runs(log: DataFrame, metrics: tuple[str, ...] = ("accuracy", "precision", "recall")) -> DataFrame:
    """(metric, run, value): the first run with the largest value."""
    long = log.select("run", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("s")).select("run", "s.*")
    return long.groupBy("metric").agg(F.max(F.struct("value", (-F.col("run")).alias("r"))).alias("b")).select("metric", (-F.col("b.r")).alias("run"), F.col("b.value").alias("value"))


def report(log: DataFrame, metric: str = "accuracy") -> str:
    """The best run's record as indented JSON."""
    best = log.orderBy(F.desc(metric), "run").limit(1).collect()
    return json.dumps(best[0].asDict() if best else {}, indent=4)


def compare_models(spark: SparkSession, logs: dict[str, DataFrame]) -> DataFrame:
    """Best run by accuracy of each model."""
    parts = [log.withColumn("model", F.lit(name)) for name, log in logs.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy("model").orderBy(F.desc("accuracy"), "run")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
