"""Incremental ingest: each text file is taken once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.functions.rules import extract
from folium.sources.files import document_id


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """document_id and text of the files below a folder, as a stream."""
    texts = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).schema("value string").text(folder)
    return texts.select(document_id(F.col("_metadata.file_path")).alias("document_id"), F.col("value").alias("text"))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Extract the fields of the files that are new, append them to a table and end."""
    rows = extract(text_stream(spark, folder))
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
