"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, and rows of them, at most: those of the smallest hashes of doc_id and text.
SAMPLE = 6000


def remainder(doc_id: str, of: int):
    """crc32 of the id as text, modulo of; a null id has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def sample(spark: SparkSession, sf_dir: str, docs: DataFrame, label: str, of: int, held_out: int, rows: int = SAMPLE) -> DataFrame:
    """text, y and a and b (hashes that order the rows) of at most so many labelled documents that aren't held out.

    A document with several labels counts with the largest. Rows may repeat a doc_id: first_rows() bounds what is fitted on.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    labels = labels.where(remainder("doc_id", of) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the parameter bounds what is broadcast
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"))


def first_rows(hashed: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """So many rows at most, by a and b, whatever number of rows share a doc_id; hashed has a and b, and no texts any more."""
    return hashed.orderBy("a", "b").limit(rows)
