import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folium.functions import geometry, json_text, normalize, rules, validate
from folium.operators import merge, review, scoring, split


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("recipient", "customer x", "mer x"),
        ("document_number", "no numbers here at all", "all"),
        ("document_date", "10.20.30.40", "10.20.30"),
        ("national_id", "ID: 12345678901", "12345678901"),
        ("national_id", "call 12345678", "12345678"),
        ("phone_number", "tel +964 750 123 4567.", "+964 750 123 4567"),
        ("full_name", "x\nJOHN MARK\ny", "JOHN MARK"),
        ("area_m2", "about ٢٥٠ م wide", "٢٥٠"),
        ("subject", "Subject: - \t", ""),
        ("subject", "nothing", None),
        ("address", None, None),
    ],
)
def test_rules(spark, name, text, want):
    assert one(spark, rules.field(F.col("v"), name), text) == want


def test_matches_need_some_characters():
    assert rules.needed(r"(\+?964[\d\s\-]{7,}\d)") == "964"
    assert rules.needed(r"(وه?بەره[یي]نان[^\n]{0,40})") == "بەره"
    assert rules.needed(r"^([A-Z][A-Z]+(?:\s+[A-Z][A-Z]+){1,3})$") == rules.needed("(ژ|ر)") == rules.needed("(?:ژ)?[0-9]") == ""
    for alternatives in rules.RULES.values():
        for p in alternatives:
            assert rules.needed(p) in p


def test_repeated_is_the_count_of_grams(spark):
    """Both forms against counts of 2-, 3- and 4-grams, over white space of ASCII and beyond."""
    rng = random.Random(5)
    texts = [None, "", " ", "a b a b a b a b", "a b a b a b a", "x " * 400, "ä\u00a0b " * 4, "a\x1cb\u2003" * 4, "a\u200bb " * 4 + "c d e f"]
    texts += [rng.choice(" \t\n\u3000").join(rng.choices("abcdeز", k=rng.randrange(4, 40))) for _ in range(300)]

    def want(text):
        ws = (text or "").split()
        counts = Counter(tuple(ws[i : i + n]) for n in (2, 3, 4) for i in range(len(ws) - n + 1))
        return len(ws) >= 8 and max(counts.values()) >= 4

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    assert {r.k: r.repeated for r in validate.repeated_rows(rows, "k", "v").collect()} == {k: want(t) for k, t in enumerate(texts)}
    assert {r.k: r.r for r in rows.select("k", validate.repeated(F.col("v")).alias("r")).collect()} == {k: want(t) for k, t in enumerate(texts)}


def test_extract_fills_the_schema(spark):
    row = rules.extract(spark.createDataFrame([("Identity Card",)], "text string")).first()
    assert (row.document_type, row.attachments, row.stamp_present, row.confidence_notes) == ("Identity Card", [], None, rules.NOTE)


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("document_number", "1", "red"),
        ("document_number", "12/٣٤", "green"),
        ("document_number", "", "yellow"),
        ("document_date", "1/2/2020", "green"),
        ("document_date", "soon", "red"),
        ("area_m2", "1,250 m2", "green"),
        ("phone_number", "+964 750 123", "green"),
        ("subject", "x" * 181, "red"),
        ("recipient", "x" * 261, "yellow"),
        ("recipient", "a b a b a b a b", "red"),
        ("recipient", "a b c d e f g h", "green"),
        ("extraction_confidence", "0.8", "green"),
        ("extraction_confidence", "0.5", "yellow"),
        ("extraction_confidence", "nan", "green"),
        ("extraction_confidence", "bad", "red"),
    ],
)
def test_lights(spark, name, value, want):
    assert one(spark, validate.light(name, F.col("v"))["status"], value) == want


@pytest.mark.parametrize(("text", "want"), [("كتاب", "کتاب"), ("ه‌ولێر", "ەولێر"), ("۱۲", "١٢"), ("12:30", "12: 30"), ("a  b ،c", "a b، c"), ("é", "é"), ("", ""), (None, None), ("ھ‌ا", "ه ا")])
def test_normalize(spark, text, want):
    assert one(spark, normalize.normalize(F.col("v")), text) == want


def test_json(spark):
    parsed = lambda t: one(spark, F.try_variant_get(json_text.parse(F.col("v")), "$.a", "string"), t)
    assert parsed('```json\n{"a": "x\\q"}\n```') == "x\\q"
    assert parsed('{"a": "cut"') is None
    assert one(spark, json_text.parse_error(F.col("v")), '{"a": }') == "JSON parse failed"
    line = one(spark, json_text.record_line(F.col("v"), F.lit(1).alias("n")))
    assert json.loads(line) == {"v": None, "n": 1} and line.startswith('{"v"')


def test_geometry(spark):
    assert one(spark, geometry.any_kind(F.col("v"), "stamp"), [], "array<struct<kind:string>>") is None
    assert one(spark, geometry.confidence_mean(F.col("v")), [0.5, None, 0.25], "array<double>") == 0.375
    assert one(spark, geometry.flat_to_polygon(F.col("v")), [1.0, 2.0], "array<double>") is None


def test_scoring_quirks(spark):
    board = spark.createDataFrame([("b", 0.0, 0), ("a", None, 1), ("c", 0.5, 9)], "engine string, field_accuracy double, error_pages int")
    assert [r.engine for r in scoring.ranked(board).collect()] == ["c", "b", "a"]
    outputs = spark.createDataFrame([("d", 1, True, "x")], "document_id string, page int, stamp_present boolean, subject string")
    truth = spark.createDataFrame([("d", 1, "True", "y", " n ")], "document_id string, page int, stamp_present string, subject string, national_id string")
    row = scoring.score(outputs, truth, ["document_id", "page"]).first()
    assert (row.total, row.correct, row.missing_fields, row.wrong_fields) == (3, 1, "national_id", "subject")


def test_review_and_merge(spark):
    assert one(spark, review.confidence(F.lit(0.0), F.lit(0.7))) == 0.7
    assert one(spark, review.parse_lines(F.col("v")), " a \n\n b") == ["a", "b"]
    assert one(spark, merge.prefer_list(F.array().cast("array<string>"), F.array(F.lit("r")))) == ["r"]
    ids = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "id string, at int")
    assert sorted(r.id for r in merge.unique_ids(ids, "id", "at").collect()) == ["x", "x_2", "y"]
    single = split.split_by_source(spark.createDataFrame([("s",)], "source string"), "source", 1.0).first()
    assert single.split == "train"
