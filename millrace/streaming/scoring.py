"""Scoring of streams: preparation is fitted once, so a stream needs stateless expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import Model
from ..operators.prep import Scale


def scored(stream: DataFrame, scale: Scale, age: str, features: list[str], model: Model) -> DataFrame:
    """Standardizes a column with fitted statistics, imputes the fitted mean (0 after standardizing) and adds the class; works on batches and streams."""
    z = F.coalesce((F.col(age) - scale.mean) / (scale.sd or 1.0), F.lit(0.0))
    return stream.withColumn(age, z).withColumn("predicted", model.predict(features))


def hits_by_window(scored_: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows and positive classes per time window; rows later than the watermark are left out once their window is closed."""
    return scored_.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == 1).alias("n_positive"))
