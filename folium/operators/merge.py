"""Records of several origins merged, and lookups by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import strip

# OCR engines in order of preference, and what stands for a page that none has read.
PRIORITY = ("paddle", "surya", "easyocr", "docling", "trocr")
NO_TEXT = "No OCR text available. Run an OCR engine (e.g., paddle, surya) to generate raw text."


def prefer(first: Column, second: Column) -> Column:
    """first unless it is null; an empty text counts as a value."""
    return F.coalesce(first, second)


def prefer_list(first: Column, second: Column) -> Column:
    """first unless it is null or an empty list."""
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(second)


def corrected(extracted: Column, correction: Column) -> Column:
    """A correction (VARIANT) over an extracted text: an object with a key "value" gives that, even null; of the rest all but null and [] win, as text."""
    kind = F.schema_of_variant(correction)
    inner = F.try_variant_get(correction, "$.value", "variant")
    text = F.when(kind.startswith("BOOLEAN"), F.initcap(F.try_variant_get(correction, "$", "string"))).otherwise(F.try_variant_get(correction, "$", "string"))
    none = correction.isNull() | (kind == "VOID") | (kind.startswith("ARRAY") & (F.size(F.try_variant_get(correction, "$", "array<variant>")) == 0))
    return F.when(none, extracted).when(kind.startswith("OBJECT") & inner.isNotNull(), F.try_variant_get(correction, "$.value", "string")).otherwise(text)


def filled(df: DataFrame, other: str, keys: tuple[str, ...]) -> DataFrame:
    """df with each key that it has no column for taken from the struct other."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({k: F.col(other)[k] for k in keys if k.lower() not in have})


def edited(records: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """records with the columns of their edits in place of their own, even where an edit is null; records without edits stay."""
    new = [c for c in edits.columns if c not in keys]
    marked = edits.select(*keys, F.struct(*new).alias("_edit"))
    joined = records.join(marked, keys, "left")
    own = [F.when(F.col("_edit").isNotNull(), F.col("_edit")[c]).otherwise(F.col(c) if c in records.columns else F.lit(None)).alias(c) for c in new]
    return joined.select(*[c for c in records.columns if c not in new], *own)


def text_by_priority(pages: DataFrame, texts: DataFrame, keys: list[str], priority: tuple[str, ...] = PRIORITY, default: str = NO_TEXT) -> DataFrame:
    """pages with raw_text: of the engines' non-blank texts for a page the first by priority, else the default.

    texts has the keys, engine and text; engines that aren't listed aren't asked. The pick is an aggregate, so no page's
    texts are sorted or gathered.
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("engine"))
    stripped = strip(F.col("text"))
    found = texts.select(*keys, rank.alias("_rank"), stripped.alias("_text")).where("_rank > 0 AND _text <> ''")
    found = found.groupBy(*keys).agg(F.min(F.struct("_rank", "_text"))["_text"].alias("_text"))
    return pages.join(found, keys, "left").withColumn("raw_text", F.coalesce("_text", F.lit(default))).drop("_text")


def missing(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_ids(rows: DataFrame, identity: str, order: str) -> DataFrame:
    """Repeated ids get _2, _3, ... in order."""
    n = F.row_number().over(Window.partitionBy(identity).orderBy(order))
    return rows.withColumn(identity, F.when(n > 1, F.concat(F.col(identity), F.lit("_"), n.cast("string"))).otherwise(F.col(identity)))


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows, with the sorted union of the columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
