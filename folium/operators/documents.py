"""A document's record out of four origins: its OCR text, rules, a vision model's fields, and the model's second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import json_text, rules
from folium.operators import merge, records

TEXTS = tuple(rules.RULES)
LISTS = ("attachments", "uncertain_lines")
FLAGS = ("stamp_present", "signature_present")
FIELDS = (*TEXTS, *LISTS, *FLAGS, "confidence_notes")
#: Characters of the first pass that a question for the second look quotes.
QUOTED = 3000


def _value(answer: Column, name: str) -> Column:
    """A field of an answer (VARIANT), of its type; null if it is missing, null or an empty list."""
    if name in LISTS:
        return F.nullif(F.try_variant_get(answer, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    return F.try_variant_get(answer, f"$.{name}", "boolean" if name in FLAGS else "string")


def _given(answer: Column, name: str) -> Column:
    """Whether an answer has a value for a field that is neither null nor []."""
    kind = F.schema_of_variant(F.try_variant_get(answer, f"$.{name}", "variant"))
    empty = F.coalesce(F.size(F.try_variant_get(answer, f"$.{name}", "array<variant>")) == 0, F.lit(False))
    return F.coalesce(kind != "VOID", F.lit(False)) & ~empty


def _corrected(answer: Column, name: str, kept: Column) -> Column:
    """A second look's value, unwrapped where it is an object with a key "value", even if that is null; else what was kept."""
    inner = F.try_variant_get(answer, f"$.{name}.value", "variant")
    wrapped = F.try_variant_get(answer, f"$.{name}.value", "array<string>" if name in LISTS else "boolean" if name in FLAGS else "string")
    return F.when(_given(answer, name), F.when(inner.isNotNull(), wrapped).otherwise(_value(answer, name))).otherwise(kept)


def usable(answer: Column) -> Column:
    """An answer that could be parsed and says no error."""
    return answer.isNotNull() & F.try_variant_get(answer, "$.error", "variant").isNull()


def merged(pages: DataFrame) -> DataFrame:
    """input_file, image_file, ocr_engine, ocr_text, ocr_avg_confidence, extraction_mode, the three structs of fields, and the times.

    pages has input_file, image_file, engine, text, avg_confidence, the answers extracted and corrected as VARIANT (null
    where no model was asked), and ocr_, extraction_ and correction_runtime_seconds (null counts as 0). A model's field wins
    over the rule's where it is neither null nor an empty list, and an empty text wins; fields that rules don't know are left
    out. An answer that says an error changes nothing. A page without text has an error and no fields.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rule = rules.extract(pages.select("*"))
    own = {f: F.col(f) for f in FIELDS}
    seen, again = usable(F.col("extracted")), usable(F.col("corrected"))
    out = rule.withColumn("rule_based_fields", F.struct(*[own[f].alias(f) for f in FIELDS]))
    first = {f: F.when(seen & _given(F.col("extracted"), f), _value(F.col("extracted"), f)).otherwise(F.col("rule_based_fields")[f]) for f in FIELDS}
    first["uncertain_lines"] = records.sanitized_lines(first["uncertain_lines"])
    out = out.withColumn("extracted_fields", F.struct(*[first[f].alias(f) for f in FIELDS]))
    second = {f: F.when(again, _corrected(F.col("corrected"), f, F.col("extracted_fields")[f])).otherwise(F.col("extracted_fields")[f]) for f in FIELDS}
    second["uncertain_lines"] = records.sanitized_lines(second["uncertain_lines"])
    out = out.withColumn("corrected_fields", F.struct(*[second[f].alias(f) for f in FIELDS]))
    seconds = [F.coalesce(F.col(f"{n}_runtime_seconds"), F.lit(0.0)) for n in ("ocr", "extraction", "correction")]
    keep = lambda c: F.when(~blank, F.col(c)).alias(c)
    return out.select(
        "input_file", "image_file", F.col("engine").alias("ocr_engine"), F.col("text").alias("ocr_text"), F.col("avg_confidence").alias("ocr_avg_confidence"),
        F.when(seen, F.lit("vlm_image")).otherwise(F.lit("rules_only")).alias("extraction_mode"), *map(keep, ("extracted_fields", "corrected_fields", "rule_based_fields")),
        *[s.alias(f"{n}_runtime_seconds") for n, s in zip(("ocr", "extraction", "correction"), seconds)], sum(seconds[1:], seconds[0]).alias("total_runtime_seconds"),
        F.when(blank, F.lit("the engine read no text")).alias("error"),
    )


def question(text: Column, fields: Column) -> Column:
    """What a model is asked at its second look: the text that was read and the first pass, of which a long one is cut."""
    first = F.to_json(fields, {"ignoreNullFields": "false"})
    cut = F.when(F.length(first) > QUOTED, F.concat(F.left(first, F.lit(QUOTED)), F.lit("\n... (truncated)"))).otherwise(first)
    head = "Compare the extracted fields with the page image. Keep what is right, correct what is wrong, fill in what can be read. Answer with one JSON object of the same keys; unclear fields are null.\n\n"
    return F.concat(F.lit(head + "Text that OCR read (noisy):\n"), F.coalesce(text, F.lit("")), F.lit("\n\nFields so far:\n"), cut, F.lit("\n\nJSON:\n"))


def parsed(answers: DataFrame, text: str = "text") -> Column:
    """The object in a model's answer as VARIANT, without repair."""
    return json_text.parse(answers[text], repair=False)
