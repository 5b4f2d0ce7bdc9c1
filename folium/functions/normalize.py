"""Unicode and keyboard normalisation of Kurdish and Arabic text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import ASCII_WHITE, WHITE, bound, is_ascii, strip

# Letters that are replaced, digits that are replaced, characters that are deleted.
MAP_FROM, MAP_TO = "كيىةۀھ‌", "کییەەه "
DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
DELETED = "ـ‍‎‏﻿"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; Spark has no such function."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _where(text: Column, test: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    return bound(text, lambda t: F.when(test(t), step(t)).otherwise(t))


def _apart(text: Column, marks: str, white: str) -> Column:
    """No white space before a mark, and some behind it."""
    return F.regexp_replace(F.regexp_replace(text, f"[{white}]+([{marks}])", "$1"), f"([{marks}])(?=[^{white}])", "$1 ")


def normalize(text: Column, digits: bool = True, composed: bool = False) -> Column:
    """Null and empty texts stay. composed: the text is in NFC already, so all is native.

    Each step runs only on texts that a cheap test finds something in. All letters that are replaced lie beyond ASCII, so texts of
    ASCII skip them, and their white space and marks are a few characters instead of many ranges.
    """
    letters = "".join(MAP_FROM + (DIGITS_FROM if digits else "") + DELETED)
    marks = "،؛؟:"
    has = lambda t, *parts: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])
    steps = [
        (lambda t: ~is_ascii(t), lambda t: F.translate(F.replace(t, F.lit("ه‌"), F.lit("ە")), letters, MAP_TO + (DIGITS_TO if digits else ""))),
        (lambda t: has(t, "  ", "\t"), lambda t: F.regexp_replace(t, r"[ \t]+", " ")),
        (lambda t: has(t, *marks), lambda t: F.when(is_ascii(t), _apart(t, ":", ASCII_WHITE)).otherwise(_apart(t, marks, WHITE))),
        (lambda t: has(t, "\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")),
    ]
    # Composition can't change ASCII: such texts don't go to Python.
    t = text if composed else F.coalesce(nfc(F.when(~is_ascii(text), text)), text)
    for test, step in steps:
        t = _where(t, test, step)
    return strip(t)


def normalize_nested(value: Column, kind: T.DataType) -> Column:
    """All strings inside arrays, structs and map values; names and keys stay. Strings must be composed."""
    if isinstance(kind, T.StringType):
        return normalize(value, composed=True)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: normalize_nested(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: normalize_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        made = F.struct(*[normalize_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    return value
