"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers and word rules."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: The white space that ends a word, and the letters that are lowered.
SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Only a local session may run without the setting; it then gets a temporary folder, kept for the session.
    """
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = spark.conf.get("millrace.shared.dir", None)
    if at is None:
        at = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("millrace.shared.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and rereads it: lineage ends here, and lost executors take nothing along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a table made by `materialize` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker is sent at once: so many rows of text, or 16 MB where the engine can bound bytes.

    Frames are lazy, so the bound is one for all operators and stays with the session; lower settings of the session's own are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def binary(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def words_of(text: Column) -> Column:
    """Words of a whole text, lower-cased in A-Z only; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_SPLIT), lambda w: w != "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values; wraps by intent."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps over the tasks that it runs: the value of `key`, made at its first use.

    A worker outlives an operator, and its memory is the executor's. So it holds one value: what another key had goes, before the new one is made.
    """
    held = vars(sys.modules.setdefault("_millrace_worker", types.ModuleType("_millrace_worker"))).setdefault("held", {})
    if key not in held:
        if held:
            held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's: free memory goes back to the system
                trim(0)
        held[key] = make()
    return held[key]


def partitions_for(df: DataFrame, size: int = 32 << 20) -> int:
    """Partitions to deal `df` into: the session's number, and more where the plan's estimate of bytes makes them larger than `size`."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-estimate // size), 1_000_000))
