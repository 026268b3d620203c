"""From raw documents to packed sequences: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread before the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, minhash, packing, quality
from millrace.llm.common import materialize
from millrace.llm.tokens import vocabulary


def wrapped(docs: DataFrame) -> DataFrame:
    """The whole row beside its text, so that no column of it can clash with what an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those without a letter (null and empty texts too), or whose two best languages compress alike, ties among them.

    Very long texts are judged whole; rows repeat as they come; without any row to learn from all go; an empty table stays empty.
    """
    dictionaries = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.identify(wrapped(docs), dictionaries).where("not rejected").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or the learned decision list.

    Null and empty texts fail the base rules; very long texts are judged whole; equal rows are judged alike, so ties don't arise; without a usable label only the base rules
    hold; an empty table stays empty.
    """
    rules = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(wrapped(docs), rules).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8). Rows that share a doc_id are one document; those without one stay.

    Of a group the smallest doc_id stays; null and wordless texts link with nothing and stay; very long texts are compared whole; an empty table stays empty. The ids grow with the data, so they meet the rows in a merge join at every size.
    """
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").count()
    ids = materialize(kept, "kept").hint("merge")
    once = docs.join(ids.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(ids.where("count > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture-controlled sequences of at most 2048 ids: all rows, null texts as their end id, very long ones over several sequences; an empty table gives no piece."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1)


STAGES = [("language ID", language), ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("packing", pack)]
#: SQL has no zstandard, no learned lists and no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
