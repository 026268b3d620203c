"""Sources and sinks: parquet tables, typed CSV, text records, in-memory frames, the strategy document, reports, graph export."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLICK_SCHEMA = "id long, full_name string, age double, gender string, device_type string, ad_position string, browsing_history string, time_of_day string, click int"
CATEGORICAL = ["gender", "device_type", "ad_position", "browsing_history", "time_of_day"]

#: The nine columns of the ad-click shape, derived from orders and customers (missing values by key arithmetic).
CLICK_COLUMNS = {
    "id": "o_orderkey",
    "full_name": "c_name",
    "age": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(18 + o_custkey % 47 AS DOUBLE) END",
    "gender": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'Female' WHEN c_nationkey % 3 = 1 THEN 'Male' ELSE 'Non-Binary' END",
    "device_type": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Desktop' WHEN o_orderstatus = 'O' THEN 'Mobile' ELSE 'Tablet' END",
    "ad_position": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'Bottom' WHEN o_custkey % 3 = 1 THEN 'Side' ELSE 'Top' END",
    "browsing_history": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END",
    "time_of_day": "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN quarter(o_orderdate) = 1 THEN 'Afternoon' WHEN quarter(o_orderdate) = 2 THEN 'Evening' WHEN quarter(o_orderdate) = 3 THEN 'Morning' ELSE 'Night' END",
    "click": "CASE WHEN o_totalprice > 175000 THEN 1 ELSE 0 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def click_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad-click shaped view; lazy, so only columns in use are read."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(*[F.expr(x).alias(n) for n, x in CLICK_COLUMNS.items()])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one in local sessions without it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/millrace-scratch"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and rereads it: what comes after has a plan of its own, and lost executors take nothing along."""
    path = scratch_path(df.sparkSession, f"millrace-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by `settled` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values become NULL once, where data come in; later steps need not know NaN."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row and declared types; empty and NaN fields are NULL."""
    return nan_to_null(spark.read.option("header", True).option("nanValue", "NaN").schema(schema).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def load(source: str, spark: SparkSession, data: str | DataFrame, schema: str = CLICK_SCHEMA) -> DataFrame:
    """Source dispatch: 'csv' or 'csvFilePath' reads a file, 'pd' or 'dataFrame' passes a frame through; others are errors."""
    if source in ("csv", "csvFilePath"):
        return read_csv(spark, data, schema)
    if source in ("pd", "pandasDataFrame", "dataFrame"):
        return data if isinstance(data, DataFrame) else nan_to_null(spark.createDataFrame(data))
    raise ValueError(f"unknown source: {source}")


def read_records(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """White-space separated text lines without their first `skip`: (i, fields). Files follow each other by path, as one sequence of lines.

    Lines are numbered within their split, and splits by the counts of those before: only counts meet in one task.
    """
    from pyspark.sql.window import Window

    split = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("at"))
    counts = spark.read.text(path).groupBy(*split).agg(F.count("*").alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("at")) - 1).join(counts, ["f", "b"])
    numbered = numbered.withColumn("i", F.col("before") + F.col("k") - skip)
    return numbered.where("i >= 0").select(F.col("i").cast("long"), F.split(F.trim("value"), r"\s+").alias("fields"))


def stitch_pairs(df: DataFrame, index: str, from_even: dict[str, str], from_odd: dict[str, str]) -> DataFrame:
    """Joins each even row with the odd one after it: one aggregate by floor(index / 2). Maps name output columns to input columns."""
    odd = F.pmod(F.col(index), F.lit(2)) == 1
    picks = [F.max(F.when(~odd, F.col(c))).alias(n) for n, c in from_even.items()] + [F.max(F.when(odd, F.col(c))).alias(n) for n, c in from_odd.items()]
    return df.groupBy(F.floor(F.col(index) / 2).alias("pair")).agg(*picks)


def two_clusters(spark: SparkSession, n: int = 50, seed: int = 0, std: float = 0.6) -> DataFrame:
    """A synthetic sample of two round clusters: x1, x2, y in {0, 1}."""
    y = (F.col("id") % 2).cast("int")
    return spark.range(n).select((F.randn(seed) * std + y * 3).alias("x1"), (F.randn(seed + 1) * std + 4 - y * 3).alias("x2"), y.alias("y"))


#: The document's nested schema.
STRATEGY_SCHEMA = (
    "strategyId string, strategyName string, description string, tickers array<struct<symbol:string,displayName:string,allocation:double>>, "
    "timeframe struct<start:string,end:string>, settings struct<initialCapital:int,rebalanceFrequency:string,benchmark:string>, "
    "additionalProperties struct<indicators:array<struct<name:string,parameters:map<string,double>>>,riskManagement:struct<stopLoss:double,takeProfit:double,positionSizing:string>,notes:string>"
)


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRATEGY_SCHEMA).option("multiLine", True).json(path)


def parse_strategies(df: DataFrame, column: str) -> DataFrame:
    """Documents in a text column as typed columns."""
    return df.select(F.from_json(F.col(column), STRATEGY_SCHEMA).alias("d")).select("d.*")


def strategy_indicators(strategies: DataFrame) -> DataFrame:
    """One row per indicator and parameter."""
    i = strategies.select("strategyId", F.explode("additionalProperties.indicators").alias("i"))
    return i.select(F.col("strategyId").alias("strategy_id"), F.col("i.name").alias("indicator"), F.explode("i.parameters").alias("parameter", "value"))


def report(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, for logs and consoles."""
    return df.select(F.to_json(F.struct("*")).alias("report"))


def save_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
