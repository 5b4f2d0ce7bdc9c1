"""Page records: the flat projection of an engine's result, names, confidences, and what a model's answer leaves of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import json_text, normalize

# The columns of a flat page record, in order, and their types.
SCHEMA = {
    "document_id": "string", "page": "int", "engine": "string", "preprocessing_mode": "string", "document_type": "string", "full_name": "string", "national_id": "string",
    "reference_number": "string", "ministry_or_department": "string", "issue_date": "string", "address": "string", "subject": "string", "decision_or_status": "string",
    "stamp_present": "boolean", "signature_present": "boolean", "raw_text": "string", "confidence_notes": "string", "runtime_seconds": "double", "gpu_memory_mb": "double",
    "avg_ocr_confidence": "double", "error": "string",
}
# The fields whose presence stands for a confidence that a model doesn't give.
FILL = ("document_type", "full_name", "national_id", "reference_number", "ministry_or_department", "issue_date", "address", "subject", "decision_or_status")
#: Characters of a raw answer that are kept: with an error, after clean-up, and of a process's errors.
RAW, RAW_CLEANED, TAIL = 4000, 2000, 4000
#: Uncertain lines that are kept.
LINES = 10


def flat(rows: DataFrame) -> DataFrame:
    """The columns of SCHEMA, in order and of their types; what rows has no column for is null. Extra columns are left out."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(have[n]) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in SCHEMA.items()])


def stem(document_id: Column, page: Column, *parts: Column) -> Column:
    """<document>_p<three digits of the page>_<parts>."""
    return F.concat_ws("_", document_id, F.format_string("p%03d", page.cast("int")), *parts)


def fill_rate(columns: list[str], fields: tuple[str, ...] = FILL) -> Column:
    """The share of the fields that aren't null, to four places; a field without a column counts as missing."""
    filled = [F.col(f).isNotNull().cast("int") for f in fields if f in columns]
    return F.round(sum(filled, F.lit(0)) / len(fields), 4)


def with_confidence(rows: DataFrame, fields: tuple[str, ...] = FILL) -> DataFrame:
    """rows with avg_ocr_confidence in place of extraction_confidence: the model's where it gives one, else the fill rate."""
    rate = fill_rate(rows.columns, fields)
    if "extraction_confidence" not in rows.columns:
        return rows.withColumn("avg_ocr_confidence", rate)
    return rows.withColumn("avg_ocr_confidence", F.coalesce(F.col("extraction_confidence").cast("double"), rate)).drop("extraction_confidence")


def sanitized_lines(lines: Column) -> Column:
    """Each line once, in order, the first ten of them."""
    return F.slice(F.array_distinct(lines), 1, LINES)


def sanitized(rows: DataFrame) -> DataFrame:
    """rows with their uncertain_lines and raw_output cut to what is kept."""
    changed = {}
    if "uncertain_lines" in rows.columns:
        changed["uncertain_lines"] = sanitized_lines(F.col("uncertain_lines"))
    if "raw_output" in rows.columns:
        changed["raw_output"] = F.left("raw_output", F.lit(RAW_CLEANED))
    return rows.withColumns(changed) if changed else rows


def with_answers(rows: DataFrame, text: str = "text", kept: int = RAW, repair: bool = True, normalized: bool = True) -> DataFrame:
    """rows with the record's columns out of a model's answer, not_text, its error, and the start of the answer where there is one.

    The answer is parsed in a projection of its own: every column reads the parsed object. An answer without an object keeps its
    start, without fence and outer white space, and its error says where parsing failed. normalized: all texts are normalised.
    """
    v, whole = F.col("_answer"), F.col("_whole")
    read = rows.withColumns({"_whole": json_text.unfenced(F.col(text)), "_payload": json_text.payload(F.col(text)), "_answer": json_text.parse(F.col(text), repair)})
    read = read.withColumn("_broken", json_text.where_broken(F.when(v.isNull(), F.col("_payload"))))
    if normalized:
        read = read.withColumn("_answer", json_text.composed(v))
    clean = normalize.normalize if normalized else lambda c, **_: c
    broken = F.concat_ws(": ", F.lit(json_text.FAILED), "_broken")
    error = F.when(F.col("_payload").isNull(), F.lit(json_text.NO_OBJECT)).when(v.isNull(), clean(broken))
    own = lambda name: clean(F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")), composed=True)
    raw = F.when(error.isNotNull(), clean(F.left(whole, F.lit(kept)))).otherwise(own("raw_output"))
    made = [*json_text.coerce(v, normalized), F.coalesce(error, own("error")).alias("error"), raw.alias("raw_output")]
    names = {*json_text.TEXT_FIELDS, *json_text.LIST_FIELDS, *json_text.FLAG_FIELDS, "extraction_confidence", json_text.NOT_TEXT, "error", "raw_output", text}
    return read.select(*[c for c in rows.columns if c not in names], *made)


def image_path(images: Column, variant: str, raw_image: Column) -> Column:
    """A variant's image, or the raw one where there is none."""
    return F.coalesce(F.nullif(images[variant], F.lit("")), raw_image)


def present(fields: Column) -> Column:
    """A map of fields without those that are null or, as lists are written, empty."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != "[]"))


def error_tail(text: Column) -> Column:
    """The end of a process's errors, which says what failed."""
    return F.right(text, F.lit(TAIL))


def is_empty(value: Column, is_list: bool = False) -> Column:
    """Null, an empty text or an empty list."""
    return value.isNull() | ((F.size(value) == 0) if is_list else (value.cast("string") == ""))


def by_modes(pages: DataFrame, modes: tuple[str, ...] = ("raw", "clean", "binarized"), engines: tuple[str, ...] = ()) -> DataFrame:
    """A row for each page and mode, and engine if some are named; what a page has, such as its regions, is on each."""
    out = pages.select("*", F.explode(F.array(*map(F.lit, modes))).alias("preprocessing_mode"))
    return out.select("*", F.explode(F.array(*map(F.lit, engines))).alias("engine")) if engines else out
