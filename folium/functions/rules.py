"""Ordered regular-expression extraction of document fields, as column expressions.

Each field has alternatives; the first, in list order, that matches anywhere gives its group 1, without the marks of
STRIP at both ends. Every group takes at least one character, so regexp_extract's empty string always means no match, and
coalesce stops at the first match. A match of nothing but marks gives an empty string, no match gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that are stripped off a match, and letters with several codings.
STRIP = " :\u202c-\t\r\n"
YA, HE, RA, KAF = "[یي]", "[ەهة]", "[ڕر]", "[کك]"

# The alternatives of each field, in order.
RULES: dict[str, list[str]] = {
    "document_type": [
        r"((?:Identity|ID)\s*Card)",
        r"((?:Birth|Death|Marriage)\s*Certificate)",
        r"((?:Official|Governmental)\s*Letter)",
        r"((?:Decree|Decision|Order)\b[^\n]{0,60})",
        r"(بەلگەنامەی\s*[^\n]{0,60})",
        r"(کارتی\s*(?:ناسنامە|ناسینەوە)[^\n]{0,40})",
        r"((?:شهادة|وثيقة|قرار|قانون|أمر)[^\n]{0,60})",
    ],
    "recipient": [
        r"(?:recipient|to)\s*[:\u202c\-]?\s*([^\n]{2,80})",
        rf"(ر{YA}?باز\s*ه{YA}وا[^\n]{{0,40}})",
        rf"(ب{HE}?ڕیز[^\n]{{0,80}})",
        rf"(بهریوهب{HE}?ری[^\n]{{0,80}})",
    ],
    "subject": [
        rf"(باب{HE}ت[:\u202c\-]?\s*[^\n]{{2,120}})",
        r"(?:subject|الموضوع|سەبارەت)\s*[:\u202c\-]?\s*([^\n]{2,120})",
    ],
    "document_number": [
        r"(?:ref|no|number)\D*([A-Za-z0-9٠-٩/\-]{3,})",
        rf"(ژمار{HE}?\s*[0-9٠-٩/\-]{{2,}})",
    ],
    "document_date": [r"([0-9٠-٩]{1,4}[/\-.][0-9٠-٩]{1,2}[/\-.][0-9٠-٩]{1,4})"],
    "project_name": [
        r"(داون\s*تاون[^\n]{0,40})",
        rf"(پر{KAF}{HE}?ژ\s*[^\n]{{1,80}})",
        rf"(پرژ{HE}[^\n]{{1,40}})",
        r"(?:project|project\s*name)\s*[:\u202c\-]?\s*([^\n]{2,80})",
    ],
    "location": [
        rf"(سل{YA}مان{YA}?[^\n]{{0,20}})",
        r"((?:شار|شەهر|مدینة)[^\n]{0,40})",
    ],
    "area_m2": [r"([\d,٠-٩]+(?:\.\d+)?)\s*(?:م²|m²|sqm|م)"],
    "referenced_decision_number": [
        rf"(ب{RA}{YA}ار[^\n]{{0,20}}ن?{RA}?جوم{HE}ن{YA}?[^\n]{{0,60}})",
        rf"(بریار[^\n]{{0,20}}ن?جوم{HE}ن{YA}?[^\n]{{0,40}})",
        r"(?:decision\s*no|decree|order)[.:;\s]*([A-Za-z0-9٠-٩/\-]{3,})",
    ],
    "sender_or_department": [
        r"((?:Ministry|Directorate|Department|Investment)[^\n]{0,80})",
        rf"(وه?بەره{YA}نان[^\n]{{0,40}})",
        rf"(ب{HE}?ڕیوەبەرا{YA}?ەت{YA}?[^\n]{{0,80}})",
        r"((?:وەزارەتی|وزارة|مدیرية)[^\n]{0,80})",
    ],
    "full_name": [
        r"(?:name|full\s*name|ناوی\s*تەواو|الاسم\s*الكامل|الاسم)\s*[:\u202c\-]?\s*([\w؀-ۿ][^\n]{2,60})",
        r"(?:ناو|الاسم)\s*[:\u202c\-]?\s*([\w؀-ۿ][^\n]{2,50})",
        r"^([A-Z][A-Z]+(?:\s+[A-Z][A-Z]+){1,3})$",
    ],
    "national_id": [r"(?:national\s*id|id)\D*([0-9]{8,14})", r"([0-9]{8,14})"],
    "phone_number": [r"(\+?\d[\d\s\-]{7,}\d)", r"(\+?964[\d\s\-]{7,}\d)"],
    "address": [r"(?:address|ناونیشان|العنوان)\s*[:\u202c\-]?\s*([^\n]+)"],
    "decision_or_status": [
        r"(?:status|decision)\s*[:\u202c\-]?\s*([^\n]+)",
        rf"(ب{RA}{YA}ار[^\n]{{0,80}})",
    ],
}
#: Ignore case, also of non-ASCII letters; ^ and $ at lines, which only LF ends; \d, \s, \w and \b by Unicode.
FLAGS = "(?iumdU)"
NOTE = "Rule-based extraction; review manually for Kurdish/Arabic variation."


#: What a pattern may lack, or that isn't itself: heads of groups, classes, escapes, and characters with a count from none on.
_LOOSE = re.compile(r"\(\?:|(?:\[[^\]]*\]|\\.)(?:[?*+]|\{[^}]*\})?|.(?:[?*]|\{0?,[^}]*\})|\{[^}]*\}|[()^$+]")


def needed(pattern: str) -> str:
    """The longest run of characters without case that every match of the pattern holds; empty if there is none."""
    runs = [] if re.search(r"\||\)(?:[?*]|\{0?,)", pattern) else _LOOSE.sub(" ", pattern).split()
    return max((r for r in runs if r.upper() == r.lower()), key=len, default="")


def _match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or null. Texts without the characters that it needs, found by a search of bytes, are not matched."""
    found = F.nullif(F.regexp_extract(text, FLAGS + pattern, 1), F.lit(""))
    return F.when(F.contains(text, F.lit(needed(pattern))), found) if needed(pattern) else found


#: What every alternative of a field holds. It is searched first, where an alternative itself goes through the rest of the text
#: behind each place that it may begin at.
HELD = {"national_id": "[0-9]{8}"}


def field(text: Column, name: str) -> Column:
    """One field of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = F.coalesce(*[_match(text, p) for p in RULES[name]])
    return F.btrim(F.when(text.rlike(HELD[name]), found) if name in HELD else found, F.lit(STRIP))


def extract(df: DataFrame, text: str = "text", fields: list[str] | None = None, notes: Column | None = None) -> DataFrame:
    """df with a column for each field, and what rules leave open: no attachments, no uncertain lines, a note."""
    found = {name: field(F.col(text), name) for name in fields or RULES}
    if fields is None:
        none = F.array().cast("array<string>")
        found |= {"attachments": none, "uncertain_lines": none, "confidence_notes": F.coalesce(F.nullif(notes, F.lit("")) if notes is not None else F.lit(None).cast("string"), F.lit(NOTE))}
        for flag in ("stamp_present", "signature_present"):
            if flag not in df.columns:
                found[flag] = F.lit(None).cast("boolean")
    return df.select("*", *[c.alias(n) for n, c in found.items()])
