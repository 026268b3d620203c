"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Each whole text, in lower case, is compressed, block by block, once per language with a zstandard compressor that holds a dictionary of that
language's sampled text. The smallest total wins; the score is the share that it saves against the second smallest, and a margin below
`min_margin` rejects.

What is learned is bounded: of each language a dictionary of `DICT_BYTES` bytes, filled by `PASSAGES` passages evenly spread over the whole text of each of at most `MAX_DOCS` sampled
documents (as long as the bytes allow; short texts come whole); of at most `MAX_LANGS` languages, those of most documents. Everything else sees whole texts and all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; ties go to the language with more training documents, then to the name that comes
first; without any training text every row is `und`; very long texts are taken whole, in blocks; a row with a null doc_id is in no fold, so it is learned from and not held
out; repeated rows and further columns are kept (those named like a result are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, small_batches, worker_cache

UND = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bounds of what is learned: languages, sampled documents a language, passages of a sampled document, bytes of a dictionary.
MAX_LANGS, MAX_DOCS, PASSAGES, DICT_BYTES = 256, 200, 4, 112 << 10
LEVEL, BLOCK, MIN_MARGIN = 6, 32 << 10, 0.002


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def passages(text: Column, chars: Column) -> Column:
    """PASSAGES pieces of `chars` characters, evenly spread over a text, or the whole of it where that is no longer."""
    size = F.length(text)
    spread = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: F.substr(text, (F.floor(i * (size - chars) / (PASSAGES - 1)) + 1).cast("int"), chars))
    return F.when(size <= PASSAGES * chars, text).otherwise(F.array_join(spread, "\n"))


def fit(train: DataFrame, max_docs: int = MAX_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from (doc_id, text, lang): at most `max_docs` sampled documents each, chosen by a hash."""
    some = train.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return {}
    of = lambda value: F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(value(n)))]), F.col("lang"))
    h = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 20))
    picked = some.where(h < of(lambda n: min(1.0, 2.0 * max_docs / n)) * (1 << 20))
    picked = picked.select("lang", h.alias("h"), passages(F.col("text"), of(lambda n: -(-dict_bytes // (PASSAGES * min(n, max_docs))))).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # of about 2 x max_docs rows a language
    rows = picked.withColumn("k", rank).where(F.col("k") <= max_docs).orderBy("lang", "k").collect()
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["text"].lower().encode())
    return {k: b"\n".join(found[k])[-dict_bytes:] for k in counts if k in found}


def sizes(data: bytes, compressors: list) -> list[int]:
    """Compressed bytes of a text for each compressor; blocks keep the dictionary within reach all along."""
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(x)) for x in blocks) for c in compressors]


def compressors_of(dictionaries: dict[str, bytes]) -> list:
    def make() -> list:
        own = []
        for v in dictionaries.values():
            d = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            own.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False))
        if len(own) == 1:
            own.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        return own

    return worker_cache(("langid", tuple(hash(v) for v in dictionaries.values())), make)


def decide(text: str | None, names: list[str], compressors: list) -> tuple[str, float]:
    if not text or not names or not LETTER.search(text):
        return UND, 0.0
    got = sizes(text.lower().encode(), compressors)
    order = sorted(range(len(got)), key=got.__getitem__)
    best = order[0] if order[0] < len(names) else 0
    return names[best], max(0.0, 1 - got[order[0]] / got[order[1]])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    spark = docs.sparkSession
    small_batches(spark)
    names, shared = list(dictionaries), spark.sparkContext.broadcast(dictionaries)  # at most MAX_LANGS x DICT_BYTES
    schema = docs.drop("lang_pred", "score", "rejected").schema
    docs = docs.select(*schema.names)
    extra = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compressors_of(shared.value)
        for b in batches:
            found = [decide(x, names, own) for x in b.column(at).to_pylist()]
            out = pa.schema([*b.schema, *extra])
            yield batch(out, *b.columns, [x[0] for x in found], [x[1] for x in found], [x[0] == UND or x[1] < min_margin for x in found])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
