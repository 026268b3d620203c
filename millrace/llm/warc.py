"""WARC: captures are written as request, response (or revisit) and metadata records and put together again.

Transaction assembly joins the records of a capture through their `WARC-Concurrent-To` identifiers; one nested row per capture comes out. Record identifiers
follow from the place of a row in its file, so a repeated task writes the same ones, and a revisit names the record of its response in `WARC-Refers-To`; who reads finds the
response's page by a join on it.

Defined cases: a null html is an empty payload; a null url is written as `about:blank`; empty payloads are equal to each other; rows that repeat a
page_id and payload are all responses when that page_id is the largest of its payload; a null page_id counts as smaller than any; an empty table
gives no file and no row; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, small_batches

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, note string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {DATE}".encode()]
    head += [f"{k}: {v}".encode() for k, v in headers] + [f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def one_line(text: str) -> str:
    return " ".join(text.split())


def record_id(kind: str, row: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {row}'.encode()).digest())}"


def capture_records(page_id: int | None, url: str | None, payload: bytes, row: str, refers_to: str | None) -> list[bytes]:
    """The three records of the capture of a row; a revisit (of the row `refers_to`) keeps the HTTP head (with the full length) and leaves the payload out."""
    own, uri = record_id("response", row), one_line(url or "") or "about:blank"
    base = [("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [*base, ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id('response', refers_to)}>")]
    joined = [*base, ("WARC-Concurrent-To", f"<{own}>")]
    return [
        record("request", record_id("request", row), [*joined, ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode()),
        record("response" if refers_to is None else "revisit", own, main, http + (payload if refers_to is None else b"")),
        record("metadata", record_id("metadata", row), [*joined, ("Content-Type", "application/warc-fields")], f"page_id: {'' if page_id is None else page_id}\r\n".encode()),
    ]


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, row): row names the file and the place in it; tables that don't come from Parquet files are written first."""
    place = F.md5(F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).cast("binary")).alias("row")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")
    try:
        return pages.select(F.col("page_id").cast("long"), "url", payload, place)
    except AnalysisException:
        return materialize(pages.select("page_id", "url", "html"), "pages").select(F.col("page_id").cast("long"), "url", payload, place)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds `refers_to`, the row of the largest page_id of those with an equal payload, to the rows of smaller ones, where a payload has `least_bytes` or more."""
    p = numbered(pages).withColumn("sha", F.sha1("payload"))
    keeper = F.max(F.struct("page_id", "row"))
    again = p.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(keeper.alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha", "keeper")
    smaller = F.coalesce(F.col("page_id") < F.col("keeper.page_id"), F.col("keeper.page_id").isNotNull() & F.col("page_id").isNull())
    return p.join(again, "sha", "left").select("page_id", "url", "payload", "row", F.when(smaller, F.col("keeper.row")).alias("refers_to"))


def write_warc(pages: DataFrame, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Writes one archive per partition (a gzip member per record) into the shared folder; returns (path, n_records).

    A file gets a name of its own for each attempt of a task; only names that a finished task reports are read later, so attempts
    that are lost or repeated do no harm.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")
    out = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sink, path = None, 0, None, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                for row in b.to_pylist():
                    if sink is None:
                        at, inner = fs.FileSystem.from_uri(path)
                        at.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        sink = at.open_output_stream(inner, compression=None)
                        sink.write(packed(record("warcinfo", record_id("warcinfo", path), [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
                    for data in capture_records(**row):
                        sink.write(packed(data, level))
                        n += 1
        finally:
            if sink is not None:
                sink.close()
        if n:
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}], schema=out)

    return materialize(with_revisits(pages, least_bytes).mapInArrow(write, "path string, n_records long"), "warc-files")


def members(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            rest, z, parts = z.unused_data, zlib.decompressobj(31), []


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def as_row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict | None:
    kind, bare = headers["warc-type"], lambda k: headers[k].strip("<>") if k in headers else None
    if kind == "warcinfo":
        return None
    row = {"record_id": bare("warc-record-id"), "record_type": kind, "concurrent_to": bare("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"), "refers_to": bare("warc-refers-to")}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        full = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
        if kind == "response" and (len(payload) != full or f"sha1:{digest_of(payload)}" != headers["warc-payload-digest"]):
            raise ValueError(f"damaged payload in {row['record_id']}")
        row |= {"payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": full, "payload": payload if with_payload and kind == "response" else None}
    elif kind == "metadata":
        row["note"] = block.decode().strip()
    return row


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in `files.path`; payloads are checked against their digests."""
    small_batches(files.sparkSession)
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    out = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                at, inner = fs.FileSystem.from_uri(path)
                with at.open_input_stream(inner, compression=None) as stream:
                    rows, size = [], 0
                    for data in members(stream):
                        if row := as_row(*parsed(data), with_payload):
                            rows.append(row)
                            size += len(row.get("payload") or b"")
                        if len(rows) >= 4096 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: records meet under the identifier of the response or revisit that they are concurrent to."""
    part = F.struct("record_id", "target_uri")
    main = F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
    kind = F.col("record_type")
    return (
        records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(
            F.max(F.when(kind == "request", part)).alias("request"),
            F.max(F.when(kind.isin("response", "revisit"), main)).alias("response"),
            F.max(F.when(kind == "metadata", F.struct("record_id", "note"))).alias("metadata"),
        )
        .where(F.col("response").isNotNull())
    )


def resolved(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures, refers_to being the page of the record that a revisit names."""
    page = F.regexp_extract("metadata.note", r"page_id: (-?\d+)", 1).try_cast("long")
    flat = captures.select(page.alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("named"))
    flat = materialize(flat, "captures")
    named = flat.where("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"))
    revisits = flat.where("named is not null").join(named, "named", "left")
    first = flat.where("named is null").withColumn("refers_to", F.lit(None).cast("long"))
    return first.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return resolved(assemble(read_warc(write_warc(pages), with_payload=False)))
