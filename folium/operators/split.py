"""Training data: splits by source, chat examples, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import json_text, normalize


def source_key(source: Column, document_id: Column) -> Column:
    """Base name of the source's path, whatever slashes end it, or the document's id."""
    whole = F.coalesce(F.nullif(source, F.lit("")), document_id)
    return F.element_at(F.split(F.rtrim(whole, F.lit("/")), "/"), -1)


def split_by_source(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """rows with split: the last sources by name, so many as the ratio gives and one at least, are val; a single source is all train.

    Rows without a source are train. The number of sources and the first val name are all that the driver asks for; rows
    are told apart by that name, without a join.
    """
    sources = rows.select(key).where(F.col(key).isNotNull()).distinct()
    n = sources.count()
    if n <= 1:
        return rows.withColumn("split", F.lit("train"))
    first = sources.orderBy(F.col(key).desc()).offset(max(1, round(n * ratio)) - 1).limit(1).first()[0]
    return rows.withColumn("split", F.when(F.col(key) >= F.lit(first), F.lit("val")).otherwise(F.lit("train")))


def example_line(task: Column, image: Column, source: Column, document_id: Column, page: Column, prompt: Column, answer: Column) -> Column:
    """One chat example as a JSON line; the user's content is a list of parts, the assistant's a text, so each turn is made on its own."""
    user = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), prompt.alias("text"))).alias("content")))
    assistant = F.to_json(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    head = F.to_json(F.struct(task.alias("task"), image.alias("image"), source.alias("source"), document_id.alias("document_id"), page.alias("page")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":['), user, F.lit(","), assistant, F.lit("]}"))


# The fields of a label, in order.
TARGET = (
    "recipient", "subject", "document_number", "document_date", "project_name", "location", "area_m2", "referenced_decision_number", "attachments", "sender_or_department",
    "full_name", "national_id", "phone_number", "address", "decision_or_status", "stamp_present", "signature_present", "uncertain_lines", "extraction_confidence",
)


def label_targets(pages: DataFrame, records: DataFrame) -> DataFrame:
    """pages with target: the JSON line of the page's record by document_id and page, its strings normalised and composed; null without a record or with an error. Null lists are empty."""
    fields = [F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) if n in json_text.LIST_FIELDS else F.col(n) for n in TARGET]
    clean = records.where(F.coalesce("error", F.lit("")) == "").select("document_id", "page", F.struct(*fields).alias("_t"))
    kind = clean.schema["_t"].dataType
    target = F.to_json(normalize.normalize_nested(F.col("_t"), kind), {"ignoreNullFields": "false"})
    return pages.join(clean.select("document_id", "page", target.alias("target")), ["document_id", "page"], "left")


def content_target(document_id: Column, page: Column) -> Column:
    """What stands for a page's content until there are labels for it."""
    return normalize.normalize(F.concat_ws("\n", F.nullif(document_id, F.lit("")), F.concat(F.lit("page "), page.cast("string"))))


def examples(pages: DataFrame, metadata_prompt: str, content_prompt: str | None = None) -> DataFrame:
    """split and line of the pages' examples: one of the fields where there is a target, and if a prompt is given one of the content.

    pages has split, target, image, source, document_id and page. Both come out of one pass, without a join or union.
    """
    page = [F.col(c) for c in ("image", "source", "document_id", "page")]
    lines = [F.when(F.col("target").isNotNull(), example_line(F.lit("metadata"), *page, F.lit(metadata_prompt), F.col("target")))]
    if content_prompt is not None:
        lines.append(example_line(F.lit("content"), *page, F.lit(content_prompt), content_target(F.col("document_id"), F.col("page"))))
    return pages.select("split", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def summary(pages: DataFrame, key: str) -> DataFrame:
    """One row: examples of either split, pages without a clean target, and the sources of either, in order. pages has split, target and the key."""
    of = lambda s: F.col("split") == s
    names = lambda s: F.array_sort(F.collect_set(F.when(of(s), F.col(key))))
    has = F.col("target").isNotNull()
    return pages.agg(F.count_if(of("train") & has).alias("train_examples"), F.count_if(of("val") & has).alias("val_examples"), F.count_if(~has).alias("skipped_pages_without_clean_metadata"), names("train").alias("train_sources"), names("val").alias("val_sources"))
