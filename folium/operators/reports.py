"""Markdown reports over leaderboards, which are small: a row for each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.sources.sinks import markdown

# Headings of the reports, and the columns of their tables, in order.
TITLE = "# Benchmark Summary"
BY_NAME = ("## Engine Runtime/Confidence", ("engine", "pages", "error_pages", "avg_raw_text_chars", "avg_runtime_seconds", "avg_gpu_memory_mb", "avg_ocr_confidence"))
BY_RANK = ("## Summary Ranking By Engine", ("engine", "field_accuracy", "error_pages", "avg_runtime_seconds", "avg_gpu_memory_mb", "avg_ocr_confidence", "pages"))
NOTES = {
    "accuracy": "fields that equal the truth after white space is taken off",
    "text": "mean confidence and length of what was read; the text itself has to be looked at",
    "layout": "boxes are drawn onto the page images",
    "stamps": "regions are found by colour and shape only and have to be checked",
    "speed": "mean seconds a page",
    "memory": "peak MB of the device, where there is one",
}


def _body(board: DataFrame, part: tuple[str, tuple[str, ...]], intro: str) -> str:
    heading, columns = part
    have = [F.col(c) if c in board.columns else F.lit(None).cast("string").alias(c) for c in columns]
    notes = "\n".join(f"- {k}: {v}" for k, v in NOTES.items())
    return "\n\n".join(filter(None, [TITLE, intro, heading, markdown(board.select(*have)), "## Notes", notes])) + "\n"


def without_truth(board: DataFrame) -> str:
    """Engines by name; board has the columns of scoring.leaderboard."""
    return _body(board.orderBy("engine"), BY_NAME, "There is no truth to compare with, so engines aren't ranked.")


def with_truth(board: DataFrame) -> str:
    """Engines by rank; board is ordered already."""
    return _body(board, BY_RANK, "")


def run_header(pages: DataFrame, packets: DataFrame, source_dir: str) -> DataFrame:
    """One row: run_id (of the first page by file, or the folder's name), source_dir and packet_count."""
    first = pages.agg(F.min_by("run_id", "file_name").alias("run_id")).scalar()
    name = source_dir.rstrip("/").rsplit("/", 1)[-1]
    return packets.agg(F.count(F.lit(1)).alias("packet_count")).select(F.coalesce(first, F.lit(name)).alias("run_id"), F.lit(source_dir).alias("source_dir"), "packet_count")
