"""Token-ID files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of `BLOCK`; from each block its minimum is subtracted, the rest is packed
at the width that holds `PERCENTILE` of the block, and ids that need more bits stand whole in an exception list. An index gives where each block starts.

Layout, little-endian: magic, u64 number of documents, ids and blocks, u64 bytes of the block part; i64 document ids, u8 document id is
present, u32 tokens per document; u64 block starts; blocks. A block: u32 minimum, u8 width, u16 number of exceptions,
packed bits (lowest first), u16 exception positions, u32 exception values (above the minimum).

Defined cases: a null text is empty (its end id alone); documents with a null id come first; rows that share an id are ordered by a hash of the
text and kept all; an empty table gives no file and no row; a document may be longer than a file's usual size, as files end between documents;
further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path, partitions_for, small_batches
from .tokens import encoder, vocabulary

MAGIC = b"PFOR1\0\0\0"
BLOCK, PERCENTILE = 512, 0.9
#: Ids after which a file ends, at the next document end.
FILE_IDS = 8 << 20


def packed_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks and their bytes."""
    n = -(-len(ids) // block)
    padded = np.empty(n * block, "<u4")
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(n, block)
    least = rows.min(axis=1) if n else np.empty(0, "<u4")
    rows = rows - least[:, None]
    rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
    typical = np.partition(rows, rank, axis=1)[:, rank] if n else np.empty(0, "<u4")
    widths = np.frexp(typical.astype(np.float64))[1]
    out: list[bytes] = [b""] * n
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        for part in np.array_split(at, -(-len(at) // 256)):
            values = rows[part]
            bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(part), block, 4), axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(bits.reshape(len(part), block * w), axis=1, bitorder="little")
            over = (values >> np.uint32(w)) > 0 if w < 32 else np.zeros(values.shape, bool)
            for k, i in enumerate(part):
                where = np.flatnonzero(over[k])
                out[i] = struct.pack("<IBH", least[i], w, len(where)) + body[k].tobytes() + where.astype("<u2").tobytes() + values[k][where].astype("<u4").tobytes()
    starts = np.zeros(n, "<u8")
    if n:
        np.cumsum([len(x) for x in out[:-1]], out=starts[1:])
    return starts, b"".join(out)


def unpacked_blocks(starts: np.ndarray, data: bytes, n_ids: int, block: int = BLOCK) -> np.ndarray:
    n = len(starts)
    raw, at = np.frombuffer(data, np.uint8), starts.astype(np.int64)
    head = raw[at[:, None] + np.arange(7)].copy() if n else np.empty((0, 7), np.uint8)
    least = head[:, :4].copy().view("<u4")[:, 0] if n else np.empty(0, "<u4")
    widths, n_over = head[:, 4].astype(np.int64), head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64) if n else np.empty(0, np.int64)
    rows = np.zeros((n, block), "<u4")
    for w in np.unique(widths):
        same = np.flatnonzero(widths == w)
        size = block * int(w) // 8
        for part in np.array_split(same, -(-len(same) // 256)):
            if w:
                body = raw[(at[part] + 7)[:, None] + np.arange(size)]
                bits = np.zeros((len(part), block, 32), np.uint8)
                bits[:, :, :w] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(part), block, w)
                rows[part] = np.packbits(bits, axis=2, bitorder="little").reshape(len(part), block * 4).view("<u4")
    for i in np.flatnonzero(n_over):
        p, k = int(at[i]) + 7 + block * int(widths[i]) // 8, int(n_over[i])
        where = np.frombuffer(data, "<u2", k, p)
        rows[i, where] = np.frombuffer(data, "<u4", k, p + 2 * k)
    return (rows + least[:, None]).reshape(-1)[:n_ids]


def file_bytes(doc_ids: list[int | None], texts: list[bytes]) -> bytes:
    """texts: the ids of each document as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    starts, data = packed_blocks(ids)
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), len(starts), len(data))
    index = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    return head + index + np.array([len(x) // 4 for x in texts], "<u4").tobytes() + starts.tobytes() + data


def parse_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens per document, all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_ids, n_blocks, size = struct.unpack_from("<QQQQ", data, 8)
    p = 40
    doc_ids = np.frombuffer(data, "<i8", n_docs, p)
    there = np.frombuffer(data, np.uint8, n_docs, p := p + 8 * n_docs)
    lengths = np.frombuffer(data, "<u4", n_docs, p := p + n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks, p := p + 4 * n_docs)
    p += 8 * n_blocks
    return [int(x) if y else None for x, y in zip(doc_ids, there, strict=True)], lengths, unpacked_blocks(starts, data[p : p + size], n_ids)


def write_ids(docs: DataFrame, path: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of docs (doc_id, text) in ascending order of doc_id; returns (part, nr, path, n_docs, n_ids), one row per file, in file order by (part, nr).

    Attempts write under names of their own, and only the names that a finished task reports count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "ids")
    out = pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, nr = encoder(path), struct.pack("<I", end_id), TaskContext.get().partitionId(), 0
        doc_ids, texts, n = [], [], 0

        def flushed() -> pa.RecordBatch:
            name = f"{folder}/{part:06d}-{nr:04d}-{uuid.uuid4().hex[:8]}.pfor"
            at, inner = fs.FileSystem.from_uri(name)
            at.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(inner) as sink:
                sink.write(file_bytes(doc_ids, texts))
            return pa.RecordBatch.from_pylist([{"part": part, "nr": nr, "path": name, "n_docs": len(doc_ids), "n_ids": n}], schema=out)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(i)
                texts.append(encode(t) + end)
                n += len(texts[-1]) // 4
                if n >= file_ids:
                    yield flushed()
                    doc_ids, texts, n, nr = [], [], 0, nr + 1
        if doc_ids:
            yield flushed()

    d = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange(partitions_for(d), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(d.mapInArrow(write, "part int, nr int, path string, n_docs long, n_ids long"), "id-files")


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids` if asked for."""
    small_batches(files.sparkSession)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    placed = files.select("path", before.alias("start"))
    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, inner = fs.FileSystem.from_uri(path)
                with at.open_input_stream(inner) as source:
                    doc_ids, lengths, ids = parse_file(source.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids).view(np.uint8).data)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return placed.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(write_ids(docs, vocabulary("byte_bpe_50k.json"), end_id=2))
