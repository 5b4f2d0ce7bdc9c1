"""Queries that write what the library writes, read it back, and are held against the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import json_text
from folium.operators import merge, packets, scoring
from folium.plans.base import query, table
from folium.session import shared_folder
from folium.sources import files, sinks, versions


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/folium/{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role AS split, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a folder for each role."""
    path, turns = _path(spark, "jsonl"), table(spark, sf_dir, "conversations")
    sinks.write_jsonl(turns.select(F.col("role").alias("split"), json_text.record_line(F.col("conv_id"), F.col("turn"), F.col("text")).alias("line")), "line", path)
    kind = "conv_id long, turn long, text string"
    return spark.read.text(path).select("split", F.from_json("value", kind).alias("r")).select("r.conv_id", "r.turn", "split", "r.text")


@query("""
SELECT event_type AS engine, count(*)::VARCHAR AS pages, (round(avg(value), 4))::VARCHAR AS avg_runtime_seconds FROM events GROUP BY event_type
""")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard as CSV, its columns in order of their names."""
    path = _path(spark, "csv")
    board = scoring.leaderboard(table(spark, sf_dir, "events"), "event_type", F.lit(None).cast("string"), F.col("props"), {"avg_runtime_seconds": F.col("value")})
    sinks.write_csv(board, path)
    return spark.read.csv(path, header=True).select("engine", "pages", "avg_runtime_seconds")


@query("SELECT page_id::VARCHAR AS document_id, 1 AS page, url AS source, 'raw/' || page_id AS raw_image FROM pages")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "manifest")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.col("url").alias("source"))
    made = pages.select("document_id", "page", F.lit("raw").alias("mode"), F.concat(F.lit("raw/"), "document_id").alias("path"))
    sinks.write_manifest(pages.limit(1).withColumns({"raw_image": F.lit("old"), "images": F.lit(None).cast("map<string,string>")}), path)  # a version before
    sinks.write_manifest(files.manifest_rows(pages, made), path)
    return files.manifest_or_build(spark, path, lambda: pages).select("document_id", "page", "source", "raw_image")


@query("""
SELECT user_id, event_type, event_id, 1 + event_id % 3 AS version FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3, event_id) = 1
""")
def versions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits within seconds, each of a third of the events: the first version of each record, whatever the clock says."""
    path, events = _path(spark, "versions"), table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    for k in range(3):
        some = events.where(F.col("event_id") % 3 == k).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
        sinks.write_versions(some, path, overwrite=k == 0)
    found = sinks.first_versions(versions.read(spark, path), ["user_id", "event_type"], versions.VERSION)
    return found.select("user_id", "event_type", "event_id", versions.VERSION)


@query("SELECT event_id, event_type, strftime(ts, '%Y%m%d') AS run_id FROM events WHERE strftime(ts, '%Y%m%d') = (SELECT max(strftime(ts, '%Y%m%d')) FROM events)")
def run_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a folder for each run; the last run is read alone."""
    path = _path(spark, "runs")
    sinks.write_run(table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("r"), F.date_format("ts", "yyyyMMdd")).alias("run_id")), path)
    return packets.latest_run(spark.read.parquet(path)).select("event_id", "event_type", F.substring("run_id", 2, 8).alias("run_id"))


@query("""
SELECT user_id::VARCHAR AS document_id, (event_id % 3)::INT AS page, max_by(event_type, event_id) AS subject FROM events WHERE event_type <> 'error' GROUP BY user_id, event_id % 3
""")
def truth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth as one CSV file in order of the events, with rows that have no page; the last of a key's rows counts."""
    path = _path(spark, "truth")
    page = F.when(F.col("event_type") != "error", (F.col("event_id") % 3).cast("string")).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "events").orderBy("event_id").select(F.col("user_id").cast("string").alias("document_id"), page.alias("page"), F.col("event_type").alias("subject"))
    rows.coalesce(1).write.csv(path, header=True)
    return files.ground_truth(spark, path).select("document_id", "page", "subject")


@query("SELECT mode, conv_id || '-' || turn AS stem, text FROM conversations, (VALUES ('raw'), ('clean')) AS m(mode)")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a folder for each mode, written twice without overwriting: the second time nothing is added."""
    path = _path(spark, "texts")
    turns = table(spark, sf_dir, "conversations").select(F.explode(F.array(F.lit("raw"), F.lit("clean"))).alias("mode"), F.concat_ws("-", "conv_id", "turn").alias("stem"), "text")
    sinks.write_text(turns, path, ["mode"], overwrite=False)
    sinks.write_text(turns.withColumn("text", F.lit("new")), path, ["mode"], overwrite=False)
    return merge.stacked(spark.read.parquet(path)).select("mode", "stem", "text")
