"""Faceted filtering of records under review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import json_text
from folium.functions.text import folded, strip
from folium.operators import merge, split

# States of a review.
STATUSES = ("unchecked", "accepted", "needs_fix", "rejected")


def confidence(extraction: Column, ocr: Column) -> Column:
    """The extraction's confidence; none and 0 fall through to the OCR's."""
    return F.when(extraction.isNull() | (extraction == 0), ocr).otherwise(extraction)


def filtered(rows: DataFrame, engine: str | None = None, document: str | None = None, search: str | None = None, errors_only: bool = False, flags_only: bool = False, least_confidence: float | None = None) -> DataFrame:
    """The rows that all given facets let through; search looks into all columns, whatever the case."""
    if engine is not None:
        rows = rows.where(F.col("engine") == engine)
    if document not in (None, "All"):
        rows = rows.where(F.col("document_id").cast("string") == document)
    if search:
        rows = rows.where(F.contains(folded(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])), folded(F.lit(search))))
    if errors_only:
        rows = rows.where(F.col("error").isNotNull())
    if flags_only:
        rows = rows.where((F.coalesce("red", F.lit(0)) > 0) | (F.coalesce("yellow", F.lit(0)) > 0))
    if least_confidence is not None:
        rows = rows.where(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    return rows


def metrics(rows: DataFrame) -> DataFrame:
    """pages, documents, errors and the mean confidence."""
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("document_id").alias("documents"), F.count("error").alias("errors"), F.round(F.avg("confidence"), 2).alias("mean_confidence"))


def as_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def parse_lines(text: Column) -> Column:
    """Lines without white space around, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


# The columns of a row under review, in order.
ROW = (
    "path", "engine", "document_id", "page", "source", "image_path", "subject", "document_number", "document_date", "project_name", "location", "confidence", "runtime_seconds",
    "run_id", "extracted_at", "red_flags", "yellow_flags", "error",
)


def review_rows(records: DataFrame) -> DataFrame:
    """The columns of ROW out of records with file_path: the folder stands for a missing engine, the file's name for a missing document_id, page 0 and no flags for missing ones."""
    have = {c.lower() for c in records.columns}
    col = lambda n, kind="string": (F.col(n) if n in have else F.lit(None)).cast(kind)
    summary = lambda n: F.coalesce(F.col("validation_summary")[n].cast("int") if "validation_summary" in have else F.lit(None), F.lit(0))
    made = {
        "path": F.col("file_path"),
        "engine": F.coalesce(F.nullif(col("engine"), F.lit("")), F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)),
        "document_id": F.coalesce(F.nullif(col("document_id"), F.lit("")), F.regexp_extract("file_path", r"([^/]+?)(\.[^./]*)?$", 1)),
        "page": F.coalesce(col("page", "int"), F.lit(0)),
        "confidence": confidence(col("extraction_confidence", "double"), col("avg_ocr_confidence", "double")),
        "runtime_seconds": col("runtime_seconds", "double"),
        "red_flags": summary("red"),
        "yellow_flags": summary("yellow"),
    }
    return records.select(*[made.get(n, col(n)).alias(n) for n in ROW])


class Session:
    """Rows under review that stay in memory, or on disk, until a save: with Session(load) as s, s.rows().

    load reads the records. save() runs what writes and lets the kept rows go, whether or not it worked; the next rows() reads again.
    """

    def __init__(self, load: Callable[[], DataFrame], level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.load, self.level = load, level
        self._kept: DataFrame | None = None

    def rows(self) -> DataFrame:
        if self._kept is None:
            self._kept = review_rows(self.load()).persist(self.level)
        return self._kept

    def save(self, write: Callable[[], object]) -> None:
        try:
            write()
        finally:
            self.invalidate()

    def invalidate(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.invalidate()


def latest_run_id(rows: DataFrame) -> DataFrame:
    """run_id: the first by document and page that isn't null; null if none is."""
    return rows.where("run_id IS NOT NULL").agg(F.min_by("run_id", F.struct("document_id", "page", "run_id")).alias("run_id"))


def page_label(document_id: Column, page: Column, subject: Column) -> Column:
    """How a page is listed."""
    return F.format_string("%s | page %03d | %s", document_id, page.cast("int"), F.coalesce(F.nullif(subject, F.lit("")), F.lit("no subject")))


def options(rows: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """The distinct values of a column in order, and which one is chosen: the default if it is there, else the first."""
    found = rows.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    first = found.agg(F.coalesce(F.min(F.when(F.col("value") == F.lit(default), F.col("value"))), F.min("value")).alias("v")).scalar()
    return found.select("value", (F.col("value") == first).alias("selected")).orderBy("value")


def edited_values(edits: DataFrame) -> DataFrame:
    """Edits as a form gives them, of their types: flags, a confidence (none is 0), lists by line, and texts of which an empty one is null."""
    def of(name: str) -> Column:
        if name in json_text.FLAG_FIELDS:
            return F.coalesce(F.col(name).cast("boolean"), F.lit(False))
        if name == "extraction_confidence":
            return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))
        if name in json_text.LIST_FIELDS:
            return F.coalesce(parse_lines(F.col(name).cast("string")), F.array().cast("array<string>"))
        return F.nullif(F.col(name).cast("string"), F.lit(""))

    known = {*json_text.TEXT_FIELDS, *json_text.LIST_FIELDS, *json_text.FLAG_FIELDS, "extraction_confidence"}
    return edits.select(*[of(c).alias(c) if c in known else F.col(c) for c in edits.columns])


def reviewed(records: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Records with their edits, and review_status (one of STATUSES, else unchecked), review_notes and review_source_path; only those that were edited.

    edits has the keys, the edited fields, and review_status and review_notes.
    """
    mine = edits.select(*keys).distinct()
    both = merge.edited(records.join(mine, keys, "left_semi"), edited_values(edits), keys)
    status = F.when(F.col("review_status").isin(*STATUSES), F.col("review_status")).otherwise(F.lit(STATUSES[0]))
    return both.withColumns({"review_status": status, "review_notes": F.coalesce("review_notes", F.lit("")), "review_source_path": F.col("file_path")})


def approved_line(prompt: Column) -> Column:
    """A chat example out of an accepted record: the fields as JSON are the answer."""
    answer = json_text.record_line(*[F.col(n) for n in (*json_text.TEXT_FIELDS, *json_text.LIST_FIELDS, *json_text.FLAG_FIELDS, "extraction_confidence")])
    return split.example_line(F.lit("metadata"), F.col("image_path"), F.col("source"), F.col("document_id"), F.col("page"), prompt, answer)
