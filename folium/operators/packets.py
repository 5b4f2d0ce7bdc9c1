"""Page records gathered into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.json_text import TEXT_FIELDS


def best(value: Column, status: Column, order: Column) -> Column:
    """Aggregate: the first value, by order, that is there and green; else the first that is there."""
    there = value.isNotNull() & (value.cast("string") != "")
    pick = lambda keep: F.min(F.when(keep, F.struct(order.alias("o"), value.alias("v"))))["v"]
    return F.coalesce(pick(there & F.coalesce(status == "green", F.lit(False))), pick(there))


def latest_run(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the last run by name; run names order by time."""
    last = rows.agg(F.max(run).alias("_last"))
    return rows.join(F.broadcast(last), F.col(run) == F.col("_last"), "left_semi")


def _by_place(a: Column, b: Column) -> Column:
    """Pages hold maps, which have no order of their own."""
    return F.when(a["o"] < b["o"], F.lit(-1)).when(a["o"] > b["o"], F.lit(1)).otherwise(F.lit(0))


def packets(pages: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """A row for each source: document_id of its first page, page_count, document_fields and the pages in order.

    pages has source, document_id, page, file_name, field_validation and the fields. A document's pages meet in one row,
    which is the operator's result; a source is one file, so their number is that of its pages.
    """
    key = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.nullif(F.col("document_id"), F.lit("")), F.lit("unknown"))
    order = F.struct("document_id", "page", "file_name")
    # The named columns only: a clashing alias inside would turn the aggregate on itself.
    every = pages.columns
    return pages.groupBy(key.alias("packet")).agg(
        F.min(order)["document_id"].alias("document_id"),
        F.count(F.lit(1)).alias("page_count"),
        F.struct(*[best(F.col(f), F.col("field_validation")[f]["status"], order).alias(f) for f in fields]).alias("document_fields"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*every).alias("page"))), _by_place).alias("_pages"),
    ).select(F.col("packet").alias("source"), "document_id", "page_count", "document_fields", F.transform("_pages", lambda p: p["page"]).alias("pages"))
