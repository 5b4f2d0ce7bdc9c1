"""Exact-match scoring of extracted fields, and leaderboards of engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import strip

# The fields that are scored, in order.
FIELDS = (
    "document_type", "full_name", "national_id", "reference_number", "ministry_or_department", "issue_date", "address", "subject",
    "decision_or_status", "stamp_present", "signature_present",
)


def comparable(value: Column, kind: T.DataType) -> Column:
    """Text for comparison: null as empty, flags as True and False, no white space around."""
    text = F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")
    return F.coalesce(strip(text), F.lit(""))


def score(outputs: DataFrame, truth: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """outputs with total, correct, field_accuracy, missing_fields and wrong_fields. Truth is small and unique by keys; pages without truth have no accuracy.

    A field counts if the truth has a value for it; absent columns are null.
    """

    def side(df: DataFrame, name: str) -> Column:
        return comparable(df[name], df.schema[name].dataType) if name in df.columns else F.lit("")

    expected = truth.select(*keys, F.array(*[side(truth, f) for f in fields]).alias("_expected"))
    got = outputs.withColumn("_got", F.array(*[side(outputs, f) for f in fields]))
    joined = got.join(expected, keys, "left")
    each = F.arrays_zip(F.array(*map(F.lit, fields)).alias("f"), F.col("_got").alias("g"), F.coalesce("_expected", F.array(*[F.lit("") for _ in fields])).alias("e"))
    counted = F.filter(each, lambda x: F.coalesce(x["e"], F.lit("")) != "")
    names = lambda keep: F.array_join(F.transform(F.filter(counted, keep), lambda x: x["f"]), ",")
    right = F.size(F.filter(counted, lambda x: x["g"] == x["e"]))
    return joined.select(
        *outputs.columns,
        F.size(counted).cast("long").alias("total"),
        right.cast("long").alias("correct"),
        F.try_divide(right, F.size(counted)).alias("field_accuracy"),
        names(lambda x: x["g"] == "").alias("missing_fields"),
        names(lambda x: (x["g"] != "") & (x["g"] != x["e"])).alias("wrong_fields"),
    )


def mean(value: Column, digits: int = 4) -> Column:
    """Mean of what is a number; null if nothing is."""
    return F.round(F.avg(value.try_cast("double")), digits)


def leaderboard(rows: DataFrame, engine: str, error: Column, text: Column, means: dict[str, Column]) -> DataFrame:
    """By engine: pages, pages with an error, mean text length (null text counts as 0), and means of columns. Engines without a name are unknown."""
    return rows.groupBy(F.coalesce(F.col(engine).cast("string"), F.lit("unknown")).alias("engine")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.coalesce(error, F.lit("")) != "").alias("error_pages"),
        F.round(F.avg(F.length(F.coalesce(text, F.lit("")))), 2).alias("avg_raw_text_chars"),
        *[mean(c).alias(n) for n, c in means.items()],
    )


def ranked(board: DataFrame, accuracy: str = "field_accuracy", errors: str = "error_pages") -> DataFrame:
    """Best accuracy first, then fewer errors, then by name; an accuracy of 0 ranks as none."""
    key = F.when(F.coalesce(F.col(accuracy), F.lit(0.0)) == 0, F.lit(-1.0)).otherwise(F.col(accuracy))
    return board.orderBy(key.desc(), F.col(errors).asc(), F.col("engine").asc())
