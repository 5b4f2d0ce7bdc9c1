"""JSON that models write: found, repaired, coerced to the schema."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions import normalize
from folium.functions.text import WHITE, strip

LIST_FIELDS = ("attachments", "uncertain_lines")
FLAG_FIELDS = ("stamp_present", "signature_present")
# Fields of a record, in order.
TEXT_FIELDS = (
    "recipient", "subject", "document_number", "document_date", "project_name", "location", "area_m2", "referenced_decision_number",
    "sender_or_department", "full_name", "national_id", "phone_number", "address", "decision_or_status",
)
#: Column with the names of the text fields whose value is no text.
NOT_TEXT = "not_text"
NUMBERS = ("document_number", "referenced_decision_number")


# The fence around an answer, a backslash that escapes nothing, and why an answer has no object.
FENCE, STRAY = (r"\A```(?:json)?", r"```\z"), r'\\(?!["\\/bfnrtu])'
NO_OBJECT, FAILED = "Model did not return a JSON object", "JSON parse failed"


def unfenced(text: Column) -> Column:
    """An answer without a code fence and outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), FENCE[0], ""), FENCE[1], ""))


def payload(text: Column) -> Column:
    """What stands from the first { to the last }, without a code fence; null if there is none."""
    return F.nullif(F.regexp_extract(unfenced(text), r"(?s)(\{.*\})", 1), F.lit(""))


def _outside(text: Column, first: str, word: str, made: str) -> Column:
    """A word that starts with the letter first is replaced where it stands outside of strings."""
    others = rf'\G(?<others>(?:[^"{first}]++|"(?:[^"\\]++|\\.)*+")*+)'
    return F.regexp_replace(text, others + word, "${others}" + made)


def parse(text: Column, repair: bool = True) -> Column:
    """The object as VARIANT; null where it can't be parsed, even with stray backslashes doubled.

    Of a repeated key the last value stays; that is a setting of the session, which is made here. NaN and the infinities, which
    JSON lacks but models write, are the text NaN and infinite numbers.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    p = payload(text)
    named = lambda t: _outside(_outside(t, "N", "NaN", '"NaN"'), "I", "Infinity", "1e999")
    tries = [F.try_parse_json(p), F.when(p.rlike("NaN|Infinity"), F.try_parse_json(named(p)))]
    if repair:
        doubled = F.regexp_replace(p, STRAY, r"\\\\")
        tries += [F.try_parse_json(doubled), F.when(p.rlike("NaN|Infinity"), F.try_parse_json(named(doubled)))]
    return F.coalesce(*tries)


def parse_error(text: Column) -> Column:
    """Why a text has no object, null if it has."""
    return F.when(payload(text).isNull(), F.lit(NO_OBJECT)).when(parse(text).isNull(), F.lit(FAILED))


@F.pandas_udf(T.StringType())
def where_broken(payloads: pd.Series) -> pd.Series:
    """What is wrong with a text that isn't JSON, and where; null for null. For the few answers that fail."""

    def told(text: str) -> str | None:
        try:
            json.loads(text)
        except ValueError as e:
            return str(e)
        except RecursionError:
            return "nested too deeply"
        return None

    return payloads.map(told, na_action="ignore")


def composed(v: Column) -> Column:
    """A parsed object with all of its texts composed (NFC); ASCII ones don't leave Spark."""
    text = F.to_json(v)
    return F.coalesce(F.try_parse_json(normalize.nfc(F.when(text.rlike(r"[^\x00-\x7f]"), text))), v)


def clean_number(value: Column) -> Column:
    """Without Latin letters and white space, if it has a digit and a letter; the value itself if nothing is left."""
    mixed = value.rlike("[\\d٠-٩۰-۹]") & value.rlike("[A-Za-z]")
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", ""), f"[{WHITE}]+", ""), F.lit(":-/ "))
    return F.when(mixed, F.coalesce(F.nullif(cleaned, F.lit("")), value)).otherwise(value)


def _kind(v: Column, name: str) -> Column:
    """Type of a key's value: null if the key is missing, VOID for an explicit null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def _shown(item: Column) -> Column:
    """An item (VARIANT) as text: null and flags with a capital letter, the rest as JSON has it."""
    kind, text = F.schema_of_variant(item), F.try_variant_get(item, "$", "string")
    return F.when(item.isNull() | (kind == "VOID"), F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _items(v: Column, name: str) -> Column:
    """The items of a list as texts."""
    return F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), _shown)


def coerce_list(v: Column, name: str) -> Column:
    """A list stays, a missing key gives none, an explicit null the text None, another value itself as text."""
    kind, none = _kind(v, name), F.array().cast("array<string>")
    one = F.array(_shown(F.try_variant_get(v, f"$.{name}", "variant")))
    return F.when(kind.isNull(), none).when(kind.startswith("ARRAY"), F.coalesce(_items(v, name), none)).otherwise(one)


def coerce_flag(v: Column, name: str) -> Column:
    """Truth of the value: null and missing are false, any text but the empty one is true."""
    kind, text = _kind(v, name), F.try_variant_get(v, f"$.{name}", "string")
    number = F.try_variant_get(v, f"$.{name}", "double")
    return F.when(kind.isNull() | (kind == "VOID"), F.lit(False)).when(kind == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")).when(kind == "STRING", text != "").when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, f"$.{name}", "array<variant>")) > 0).when(kind.startswith("OBJECT"), kind != "OBJECT<>").otherwise(F.coalesce(number, F.lit(1.0)) != 0)


def coerce_confidence(v: Column, name: str = "extraction_confidence") -> Column:
    """Clamped to 0 to 1; what is no number is 0."""
    number = F.coalesce(F.try_variant_get(v, f"$.{name}", "string").try_cast("double"), F.lit(0.0))
    flag = F.try_variant_get(v, f"$.{name}", "boolean")
    value = F.when(_kind(v, name) == "BOOLEAN", flag.cast("double")).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def coerce_text(v: Column, name: str) -> Column:
    """Of a list the first three items, joined; numbers of documents cleaned; empty, null and None as null."""
    kind, text = _kind(v, name), F.try_variant_get(v, f"$.{name}", "string")
    text = F.when(kind.startswith("ARRAY"), F.array_join(F.slice(_items(v, name), 1, 3), "; ")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    if name in NUMBERS:
        text = F.when(kind.isin("STRING") | kind.startswith("ARRAY"), clean_number(text)).otherwise(text)
    return F.when(~text.isin("", "null", "None"), text)


def not_text(v: Column) -> Column:
    """The text fields that an answer gives a number, a flag or an object for: those names, in order."""
    plain = lambda kind: kind.isNull() | kind.isin("STRING", "VOID") | kind.startswith("ARRAY")
    return F.array_compact(F.array(*[F.when(~plain(_kind(v, n)), F.lit(n)) for n in TEXT_FIELDS]))


def coerce(v: Column, normalized: bool = True) -> list[Column]:
    """The record's columns out of a parsed object, and not_text; normalized: its texts are composed, and are normalised."""
    clean = (lambda c: normalize.normalize(c, composed=True)) if normalized else (lambda c: c)
    out = [clean(coerce_text(v, n)).alias(n) for n in TEXT_FIELDS]
    out += [(F.transform(coerce_list(v, n), clean) if normalized else coerce_list(v, n)).alias(n) for n in LIST_FIELDS]
    out += [coerce_flag(v, n).alias(n) for n in FLAG_FIELDS]
    return [*out, coerce_confidence(v).alias("extraction_confidence"), not_text(v).alias(NOT_TEXT)]


def record_line(*columns: Column) -> Column:
    """A JSON line in the columns' order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
