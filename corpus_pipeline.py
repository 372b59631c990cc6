"""A training corpus from the table of documents, in five stages.

Each stage works on all that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm.decontaminate import decontaminate
from courtline.llm.nearjoin import near_duplicates
from courtline.llm.packing import pack_documents
from courtline.llm.quality import classify_quality
from courtline.llm.saved import saved
from courtline.llm.substrings import remove_repeated_strings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Rows without doc_id stay; of rows that repeat a doc_id all go if one is rejected. Null and empty
    texts get the score of the bias alone. Without labels of both classes nothing is learned to reject
    but by the one class. No rows give no rows. Only the columns of documents are kept.
    """
    scored = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return _documents(docs.join(rejected, "doc_id", "left_anti"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Rows without doc_id stay, and rows that repeat a doc_id are one document: they stay or go
    together. Null and empty texts are like no other text. No rows give no rows.
    """
    gone = near_duplicates(docs).where("class_id <> doc_id").select("doc_id")
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document with a smaller doc_id has, too.

    Where a cut goes through a character, what is left of the character goes, too. A document of
    which nothing is left is dropped; null and empty texts and rows without doc_id stay as they
    are. Rows that repeat a doc_id are cut alike and stay. No rows give no rows.
    """
    rows = _documents(docs).withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    cut = remove_repeated_strings(docs, as_text=True).where("n_removed > 0").groupBy("doc_id", "crc").agg(F.min("kept").alias("kept"))
    both = rows.join(cut, ["doc_id", "crc"], "left").where("kept is null or kept <> ''")
    return both.withColumn("n_chars", F.coalesce(F.length("kept").cast("long"), "n_chars")).withColumn("text", F.coalesce("kept", "text")).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Rows without doc_id, null and empty texts stay; of rows that repeat a doc_id all go if one has a
    hit. An empty benchmark removes nothing. No rows give no rows.
    """
    return _documents(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into bins.

    Near copies left two stages ago and strings of 50 bytes that texts share one stage later, so clusters
    are texts with equal words and aren't sought by links again. Rows that repeat a doc_id or have
    none are packed each on their own; null, empty and blank texts have a row without a bin. No rows
    give no rows.
    """
    return pack_documents(docs, near=False)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicate), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", benchmark_free), ("best-fit packing", packed)]

#: The stages learn, iterate and search; SQL can't express them. A test compares each with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
