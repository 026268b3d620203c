"""Mixture-controlled packing: deficit round-robin over source queues.

Texts are encoded once; their ids are written to the shared folder with the number of each row. Documents are dealt by a hash of that number into bundles of bounded
size, whatever files they came in and however often a row repeats. Within a bundle each source is a queue. A window is so many sequences; in each, a queue earns its
target share of the window as credit and gives ids for it, cut where the credit ends. What a queue could not give or gave in excess stays in its account: over
windows as a running balance, over bundles as the balance that all bundles before leave (their share against what they hold), which is added to a bundle's first window and
paid off over as many windows as it takes. Shares, balances and sizes are all in ids.

All rows are packed: a queue that runs dry leaves its share to the others. Only the last sequence of a bundle is short; it is padded to a power of two.

Defined cases: a null text is empty (its end id alone); a null source is a queue of its own; a null doc_id is kept; repeated rows are packed each, their order is that of the
hash of their numbers, then of the numbers; a document longer than a window goes on in the next; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches
from .tokens import encoder, vocabulary

LENGTH, WINDOW_SEQUENCES, BUNDLE_IDS = 2048, 32, 3 << 20
#: Bundles whose running sums one task adds up.
SUMMED = 4096
PIECE = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("padded_to", "long"), ("source", "string")]


class Queue:
    """The documents of a source that wait, and its account in ids."""

    def __init__(self, share: float, account: float):
        self.share, self.account, self.left, self.docs = share, account, 0, deque()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append([doc_id, ids, 0])
        self.left += len(ids) // 4

    def take(self, n: int) -> Iterator[tuple[int | None, bytes, int, int]]:
        """Pieces of n ids in all: doc_id, ids of the document, start, length."""
        self.account -= n
        self.left -= n
        while n:
            doc = self.docs[0]
            doc_id, ids, start = doc
            k = min(n, len(ids) // 4 - start)
            yield doc_id, ids, start, k
            n -= k
            doc[2] += k
            if doc[2] == len(ids) // 4:
                self.docs.popleft()


def windows(queues: dict[str | None, Queue], size: int) -> Iterator[list[tuple]]:
    """Deficit round-robin: the pieces of each window of `size` ids (fewer in the last), with their source."""
    while any(q.left for q in queues.values()):
        live = {k: q for k, q in queues.items() if q.left}
        need, whole = min(size, sum(q.left for q in live.values())), sum(q.share for q in live.values())
        for q in live.values():
            q.account += size * (q.share / whole if whole else 1 / len(live))
        out: list[tuple] = []
        for k, q in live.items():
            n = max(0, min(int(q.account), q.left, need))
            out += [(*p, k) for p in q.take(n)]
            need -= n
        for k, q in sorted(live.items(), key=lambda x: -x[1].account):  # what rounding and dry queues leave open
            n = min(q.left, need)
            out += [(*p, k) for p in q.take(n)]
            need -= n
        yield out


def pieces(parts: Iterator[list[tuple]], first_sequence: int, length: int = LENGTH) -> Iterator[tuple]:
    """Lays pieces one after the other into sequences; rows of PIECE, padded_to as the full length."""
    at = 0
    for window in parts:
        for doc_id, ids, start, n, source in window:
            while n:
                k = min(n, length - at % length)
                yield doc_id, start, k, zlib.crc32(ids[4 * start : 4 * (start + k)]), len(ids) // 4, first_sequence + at // length, at % length, length, source
                at, start, n = at + k, start + k, n - k


def finished(rows: list[tuple], length: int) -> list[tuple]:
    """Sets padded_to of the last sequence to the power of two that holds it."""
    if not rows:
        return rows
    last = rows[-1][5]
    end = rows[-1][6] + rows[-1][2]
    size = min(length, 1 << (end - 1).bit_length())
    return [(*r[:7], size, r[8]) if r[5] == last else r for r in rows]


def sums_before(held: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """held with the sum of `value` over the bundles before, by keys: within runs of SUMMED bundles, and over whole runs, so no task adds up all bundles."""
    held = held.withColumn("run", F.floor(F.col("bundle") / SUMMED))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("run", *keys).agg(F.sum(value).alias("of_run"))
    runs = runs.select(F.col("run").alias("r"), *[F.col(k).alias(f"k_{k}") for k in keys], F.coalesce(F.sum("of_run").over(earlier(Window.partitionBy(*keys).orderBy("run"))), F.lit(0)).alias("runs_before"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("run", *keys).orderBy("bundle"))), F.lit(0))
    same = F.col("run") == F.col("r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return held.withColumn("inside", inside).join(runs, same).withColumn(name, F.col("inside") + F.col("runs_before")).drop("run", "r", "inside", "runs_before", *[f"k_{k}" for k in keys])


def balances(dealt: DataFrame, targets: dict[str, float] | None, total: int) -> DataFrame:
    """(bundle, source, share, balance): what the bundles before owe a source, in ids (`total` in all), for each source of a bundle."""
    held = dealt.groupBy("bundle", "source").agg(F.sum("n").alias("ids"))
    by_source = held.groupBy("source").agg(F.sum("ids").alias("of_source"))
    by_bundle = sums_before(held.groupBy("bundle").agg(F.sum("ids").alias("of_bundle")), [], "of_bundle", "all_before").select("bundle", "all_before")
    shares = by_source.select("source", (F.col("of_source") / F.lit(max(1, total))).alias("share"))
    if targets:
        known = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
        shares = shares.select("source", F.coalesce(F.element_at(known, F.col("source")).cast("double"), F.lit(0.0)).alias("share"))
    # a source that a bundle lacks is still one of those before the next: its sum is that of the bundles that have it
    own = sums_before(held, ["source"], "ids", "own_before")
    d = own.join(by_bundle, "bundle").join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return d.select("bundle", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("balance"))


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, nr, n, ids): the ids of each row of docs with the end id, and a number of the row; written once."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("nr", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, nr = encoder(path), struct.pack("<I", end_id), TaskContext.get().partitionId() << 40
        for b in batches:
            ids = [encode(t) + end for t in b.column(2).to_pylist()]
            numbers = np.arange(nr, nr + len(ids))
            nr += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([narrow(x) for x in ids], pa.binary())], schema=schema)

    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return materialize(d.mapInArrow(run, "doc_id long, source string, nr long, n long, ids binary"), "ids")


def narrow(ids: bytes) -> bytes:
    """Ids in two bytes each after a zero byte where all fit, else as they are after a one."""
    x = np.frombuffer(ids, "<u4")
    return b"\1" + ids if x.max(initial=0) >> 16 else b"\0" + x.astype("<u2").tobytes()


def wide(data: bytes) -> bytes:
    return data[1:] if data[0] else np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


def pack(docs: DataFrame, path: str, end_id: int, targets: dict[str, float] | None = None, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, bundle_ids: int = BUNDLE_IDS) -> DataFrame:
    """One row per piece (PIECE). `targets`: shares of ids by source; by default each source's share of all ids."""
    d = encoded(docs, path, end_id)
    total = d.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // bundle_ids))
    d = d.withColumn("h", F.xxhash64("nr")).withColumn("bundle", F.pmod("h", F.lit(n)).cast("long"))
    # the accounts travel in the same exchange, as rows that come first in their bundle
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    accounts = balances(d.select("bundle", "source", "n"), targets, total).select("bundle", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("nr"), nothing("long", "doc_id"), nothing("binary", "ids"), "source", "share", "balance")
    rows = d.select("bundle", F.lit(1).alias("kind"), "h", "nr", "doc_id", "ids", "source", nothing("double", "share"), nothing("double", "balance"))
    both = rows.unionByName(accounts).repartition(min(n, 100_000), "bundle").sortWithinPartitions("bundle", "kind", "h", "nr", "source")
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(k, kinds[t]) for k, t in PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, queues = None, {}

        def packed() -> Iterator[pa.RecordBatch]:
            out = finished(list(pieces(windows(queues, window_sequences * length), bundle << 32, length)), length)
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[i : i + 20_000], strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for number, kind, doc_id, ids, source, share, balance in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != bundle:
                    if queues:
                        yield from packed()
                    bundle, queues = number, {}
                if kind == 0:
                    queues[source] = Queue(share, balance)
                else:
                    queues[source].add(doc_id, wide(ids))
        if queues:
            yield from packed()

    return both.select("bundle", "kind", "doc_id", "ids", "source", "share", "balance").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in PIECE))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1)
