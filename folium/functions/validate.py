"""Traffic lights of extracted fields: green, yellow or red, with a message."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.json_text import NOT_TEXT
from folium.functions.text import bound, strip, words

# Digits of three scripts, and the shapes of valid fields.
DIGIT = "0-9٠-٩۰-۹"
SHAPES = {
    "document_number": rf"(?dU)^[{DIGIT}][{DIGIT}/\-. ]*[{DIGIT}]$",
    "document_date": rf"(?dU)^[{DIGIT}]{{1,4}}[/\-.][{DIGIT}]{{1,2}}[/\-.][{DIGIT}]{{1,4}}$",
    "area_m2": rf"(?dU)^[{DIGIT},.\s]+(?:م٢|م²|م2|m2|m²|sqm|م)?$",
    "phone_number": r"(?dU)^\+?\d[\d\s\-()]{7,}\d$",
}
# Messages of the shaped fields.
MESSAGES = {
    "document_number": ("missing document number", "document number contains invalid characters or shape", "valid document number shape"),
    "document_date": ("missing document date", "date must be shaped like day/month/year or year/month/day", "valid date shape"),
    "area_m2": ("missing area", "area should be numeric with optional square-meter marker", "valid area shape"),
    "phone_number": ("missing phone number", "phone number shape is invalid", "valid phone number shape"),
}
TEXTS = ("recipient", "project_name", "sender_or_department", "full_name", "address", "decision_or_status")
FIELDS = (*SHAPES, "subject", *TEXTS, "extraction_confidence")


def _light(status: str, message: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))


#: So often some gram of two to four words has to stand in a text of so many words at least.
OFTEN, LEAST_WORDS = 4, 8


def _often(ordered: Column) -> Column:
    """Of an ordered array a value stands four times, if some place equals the third place after it."""
    return F.exists(F.sequence(F.lit(0), F.size(ordered) - OFTEN), lambda i: F.get(ordered, i) == F.get(ordered, i + OFTEN - 1))


def repeated(text: Column) -> Column:
    """Has a text of at least eight words some 2-, 3- or 4-gram four times or more? Null has not.

    Where a longer gram stands, its first two words stand too, so pairs of words decide for all three lengths. This form stays in
    the JVM and is meant for fields, which are short; repeated_rows is for whole texts.
    """
    pairs = lambda ws: F.sort_array(F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    some = lambda ws: F.when(F.size(ws) >= LEAST_WORDS, bound(pairs(ws), _often))
    return F.coalesce(F.when(F.length(text) >= 2 * LEAST_WORDS - 1, bound(words(text), some)), F.lit(False))


def _repeats(text: str | None) -> bool:
    ws = text.split() if text else []
    return len(ws) >= LEAST_WORDS and max(Counter(zip(ws, ws[1:])).values()) >= OFTEN


@F.pandas_udf(T.BooleanType())
def _repeated_texts(texts: pd.Series) -> pd.Series:
    """As repeated(); words are those between white space of Unicode, as str.split takes it."""
    return texts.map(_repeats).astype(bool)


def repeated_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and repeated for each row, whatever other rows have the same key. All of a text is in its row, so nothing is shuffled.

    Whole texts have thousands of words; counting them in Arrow batches takes a tenth of the time that array functions take, as
    these interpret a lambda for each word.
    """
    return df.select(key, _repeated_texts(F.col(text)).alias("repeated"))


# Messages of a subject, of the other texts (after the field's name) and of a confidence.
SUBJECT = ("missing subject", "subject must be text", "subject is too long; likely body text leakage", "subject contains repeated text", "subject length looks plausible")
TEXT = ("missing {}", "{} contains repeated text", "{} is unusually long", "{} present")
CONFIDENCE = ("low model confidence", "medium model confidence", "high model confidence")


def light(name: str, value: Column, is_text: Column | None = None) -> Column:
    """struct(status, message) of a field whose value is given as a string, or null.

    is_text says whether the value is a string in its record (by default it is): a number or flag has no valid shape and is no
    subject, while the other fields take it as it is.
    """
    empty, other = value.isNull() | (value == ""), ~is_text if is_text is not None else F.lit(False)
    if name in SHAPES:
        missing, bad, good = MESSAGES[name]
        return F.when(empty, _light("yellow", missing)).when(other | ~strip(value).rlike(SHAPES[name]), _light("red", bad)).otherwise(_light("green", good))
    if name == "subject":
        missing, no_text, long, twice, good = SUBJECT
        return F.when(empty, _light("yellow", missing)).when(other, _light("red", no_text)).when(F.length(value) > 180, _light("red", long)).when(repeated(value), _light("red", twice)).otherwise(_light("green", good))
    if name == "extraction_confidence":
        v = F.coalesce(value.try_cast("double"), F.lit(0.0))
        low, medium, high = CONFIDENCE
        return F.when(v < 0.5, _light("red", low)).when(v < 0.8, _light("yellow", medium)).otherwise(_light("green", high))
    missing, twice, long, good = (m.format(name) for m in TEXT)
    return F.when(empty, _light("yellow", missing)).when(other, _light("green", good)).when(repeated(value), _light("red", twice)).when(F.length(value) > 260, _light("yellow", long)).otherwise(_light("green", good))


def validate(df: DataFrame) -> DataFrame:
    """df with field_validation (map of the twelve lights) and validation_summary (struct of counts); an absent column is empty.

    A value is no text if its column isn't one of strings, or if the column not_text (as json_text.coerce makes it) names its field.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    named = F.col(NOT_TEXT) if NOT_TEXT in kinds else None

    def one(n: str) -> Column:
        if n not in kinds:
            return light(n, F.lit(None).cast("string"))
        if not isinstance(kinds[n], T.StringType):
            return light(n, F.col(n).cast("string"), F.lit(False))
        return light(n, F.col(n), ~F.coalesce(F.array_contains(named, n), F.lit(False)) if named is not None else None)

    df = df.withColumn("field_validation", F.create_map(*[x for n in FIELDS for x in (F.lit(n), one(n))]))
    counts = [F.size(F.filter(F.map_values("field_validation"), _is(s))).alias(s) for s in ("green", "yellow", "red")]
    return df.withColumn("validation_summary", F.struct(*counts))


def _is(status: str):
    return lambda x: x["status"] == status


def _is_text(status: str):
    return lambda x: x == status
