"""The library's queries over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import geometry, json_text, normalize, rules, validate
from folium.models.engines import read_pages
from folium.operators import merge, packets, review, scoring, split
from folium.plans.base import ORACLE, QUERIES, query, quoted, rule_sql, shape_sql, table, text_light_sql  # noqa: F401
from folium.sources.files import limited

# --- rules -----------------------------------------------------------------------------------------------------------


def _rule(name: str, field: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return docs.select("doc_id", rules.field(F.col("text"), field).alias(field))

    run.__name__ = name
    query(f"SELECT doc_id, {rule_sql(field)} AS {field} FROM documents")(run)


for _name, _field in (("rule_recipient", "recipient"), ("rule_document_number", "document_number"), ("rule_document_date", "document_date"), ("rule_full_name", "full_name"), ("rule_national_id", "national_id"), ("rule_phone", "phone_number")):
    _rule(_name, _field)

# Made-up pages that each alternative of the Kurdish and Arabic rules has something to find in.
PAGES = [
    "بەلگەنامەی فەرمی ژمارە 12\nبابەت: داواکاری زەوی\nژمارە 4521/9\nسلێمانی شار",
    "کارتی ناسنامە نوێ\nناوی تەواو: ئازاد کەریم\nناونیشان: شاری هەولێر\nپرۆژە",
    "قرار رقم 55\nوزارة الاعمار\nالموضوع: تخصيص ارض\nالعنوان: بغداد",
    "Identity Card\nName: AZAD KARIM\nAddress: Main street 5\nStatus: approved - ",
    "Decision No. 778/A of the council\nProject Name: Down Town\narea 1,250.5 m² total\nSubject: - land use",
    "بڕیاری ئەنجومەنی ژمارە ١٢٣\nبریار ن جومەنی وەزیران\nداون تاون پلازا\n٢٥٠ م",
    "وەبەرهینان\nبەڕیوەبەرایەتی گشتی\nپرکەژ نوێ ١\nرێباز هیوا\nبەڕیز بەرێوەبەر",
    "JOHN MARK SMITH\nDirectorate of Roads\nOrder: 99-AB\nstatus",
    "",
]
KURDISH = ("document_type", "subject", "project_name", "location", "area_m2", "referenced_decision_number", "sender_or_department", "address", "decision_or_status")
# Each document's text, behind the page that its id falls on.
_HEAD_SQL = "CASE doc_id % " + str(len(PAGES)) + " " + " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(PAGES)) + " END"


def _sql_digits(name: str) -> str:
    # RE2's \d and \s are ASCII; the fixture's other digits are spelled out.
    return rule_sql(name).replace(r"[\d,٠-٩]", "[0-9,٠-٩]").replace(r"\.\d+", r"\.[0-9٠-٩]+")


@query(f"SELECT doc_id, {', '.join(f'{_sql_digits(n)} AS {n}' for n in KURDISH)} FROM (SELECT doc_id, {_HEAD_SQL} || chr(10) || text AS text FROM documents)")
def rule_kurdish_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.element_at(F.array(*map(F.lit, PAGES)), (F.col("doc_id") % len(PAGES) + 1).cast("int"))
    return docs.select("doc_id", F.concat(head, F.lit("\n"), "text").alias("text")).select("doc_id", *[rules.field(F.col("text"), n).alias(n) for n in KURDISH])


# --- validation ------------------------------------------------------------------------------------------------------

CHECKED = ("recipient", "document_number", "document_date", "phone_number")


_EXTRACTED = "SELECT doc_id, " + ", ".join(f"{rule_sql(n)} AS {n}" for n in CHECKED) + " FROM documents"
_LIGHTS = f"SELECT doc_id, {text_light_sql('recipient')} AS recipient, " + ", ".join(f"{shape_sql(n, n)} AS {n}" for n in CHECKED[1:]) + f" FROM ({_EXTRACTED})"


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *[rules.field(F.col("text"), n).alias(n) for n in CHECKED])


@query(_LIGHTS)
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate(_extracted(spark, sf_dir))
    return found.select("doc_id", *[F.col("field_validation")[n]["status"].alias(n) for n in CHECKED])


@query(
    # Of twelve fields four are extracted; seven are missing and yellow, the confidence is 0 and red.
    f"SELECT doc_id, {' + '.join(f'''({n} = 'green')::BIGINT''' for n in CHECKED)} AS green, {' + '.join(f'''({n} = 'yellow')::BIGINT''' for n in CHECKED)} + 7 AS yellow, "
    f"{' + '.join(f'''({n} = 'red')::BIGINT''' for n in CHECKED)} + 1 AS red FROM ({_LIGHTS})"
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate(_extracted(spark, sf_dir))
    return found.select("doc_id", *[F.col("validation_summary")[c].cast("long").alias(c) for c in ("green", "yellow", "red")])


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (
    SELECT doc_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) AS s(n) WHERE len(ws) >= 8
    )
), hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM g GROUP BY doc_id, n, gram HAVING count(*) >= 4))
SELECT doc_id, hit.doc_id IS NOT NULL AS repeated FROM documents LEFT JOIN hit USING (doc_id)
""")
def repetition_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


# --- normalisation and JSON ------------------------------------------------------------------------------------------

TYPED = ["كتاب علي مدرسة", "ه‌ولێر ۱۲۳", "a  b\t\tc", "x :y", "12:30", "one\n\n\n\ntwo", "ھ‌ا", "سـلام", "é", "   "]
_TYPED_SQL = "(VALUES " + ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(TYPED)) + ") AS t(k, text)"


def _normal_sql(text: str) -> str:
    mapped = f"translate(replace(nfc_normalize({text}), 'ه‌', 'ە'), '{normalize.MAP_FROM + normalize.DIGITS_FROM + normalize.DELETED}', '{normalize.MAP_TO + normalize.DIGITS_TO}')"
    spaced = f"regexp_replace(regexp_replace({mapped}, '[ \\t]+', ' ', 'g'), '\\s+([،؛؟:])', '\\1', 'g')"
    # RE2 has no look-ahead: what follows is taken along, twice, for marks in a row.
    apart = f"regexp_replace(regexp_replace({spaced}, '([،؛؟:])([^\\s])', '\\1 \\2', 'g'), '([،؛؟:])([^\\s])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({apart}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT k::BIGINT AS k, {_normal_sql('text')} AS text FROM {_TYPED_SQL} UNION ALL SELECT doc_id + 100, {_normal_sql('text')} FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = spark.createDataFrame([(k, t) for k, t in enumerate(TYPED)], "k long, text string")
    rows = typed.unionAll(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text"))
    return rows.select("k", normalize.normalize(F.col("text")).alias("text"))


_TYPED_CASE = "CASE doc_id % " + str(len(TYPED)) + " " + " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(TYPED)) + " END"


@query(f"SELECT doc_id, {_normal_sql('head')} || '|' || {_normal_sql('text')} || '|' || {_normal_sql('joint')} AS joined FROM (SELECT doc_id, text, {_TYPED_CASE} AS head, {_TYPED_CASE} || ' ' || text AS joint FROM documents)")
def normalize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of an array, a map and a struct, made of each document's text and what someone typed before it."""
    head = F.element_at(F.array(*map(F.lit, TYPED)), (F.col("doc_id") % len(TYPED) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", normalize.nfc("text").alias("text"), normalize.nfc(head).alias("head"))
    rows = rows.select("doc_id", F.struct(F.array("head").alias("a"), F.create_map(F.lit("key"), "text").alias("m"), F.struct(normalize.nfc(F.concat("head", F.lit(" "), "text")).alias("t")).alias("s")).alias("v"))
    out = normalize.normalize_nested(F.col("v"), rows.schema["v"].dataType)
    return rows.select("doc_id", out.alias("v")).select("doc_id", F.concat_ws("|", F.col("v.a")[0], F.col("v.m")["key"], F.col("v.s.t")).alias("joined"))


@query("SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(json_text.parse(F.col("props")), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("""
SELECT doc_id, string_agg(line, '|' ORDER BY place) AS lines FROM (
    SELECT doc_id, line, min(i) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
    ) GROUP BY doc_id, line
) WHERE n <= 10 GROUP BY doc_id
""")
def sanitize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(F.slice(F.array_distinct(F.split("text", "\n")), 1, 10), "|").alias("lines"))


# --- scoring ---------------------------------------------------------------------------------------------------------

_PREDICTED = f"""
SELECT d.doc_id, d.source, d.text, {rule_sql('national_id', 'd.text')} IS NOT NULL AS has_id, l.doc_id IS NOT NULL AS labelled, (red = 0)::INT AS p_quality, 0 AS p_toxic, l.quality, l.toxic, red, yellow, green FROM documents d
JOIN (SELECT doc_id, {" + ".join(f"({n} = 'green')::BIGINT" for n in CHECKED)} AS green, {" + ".join(f"({n} = 'yellow')::BIGINT" for n in CHECKED)} AS yellow, {" + ".join(f"({n} = 'red')::BIGINT" for n in CHECKED)} AS red FROM ({_LIGHTS})) USING (doc_id)
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
LABELS = ("quality", "toxic")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rule fields, lights of CHECKED, and predictions of the labels scored against the truth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # What later steps ask of a text is made here: the text itself doesn't go on into the join.
    text = F.coalesce("text", F.lit(""))
    made = {"has_id": rules.field(F.col("text"), "national_id").isNotNull(), "chars": F.length(text), "blank": F.trim(text) == ""}
    found = docs.select("doc_id", "source", *[c.alias(n) for n, c in made.items()], *[rules.field(F.col("text"), n).alias(n) for n in CHECKED])
    lights = F.array(*[validate.light(n, F.col(n))["status"] for n in CHECKED])
    found = found.select("doc_id", "source", *made, lights.alias("lights"))
    count = lambda s: F.size(F.filter("lights", validate._is_text(s)))
    found = found.select("doc_id", "source", *made, *[count(s).cast("long").alias(s) for s in ("green", "yellow", "red")])
    found = found.withColumns({"quality": (F.col("red") == 0).cast("int"), "toxic": F.lit(0)})
    return scoring.score(found, table(spark, sf_dir, "labels"), ["doc_id"], LABELS)


@query(f"""
SELECT doc_id, CASE WHEN labelled THEN (quality IS NOT NULL)::BIGINT + (toxic IS NOT NULL)::BIGINT ELSE 0 END AS total,
    coalesce((p_quality = quality)::BIGINT, 0) + coalesce((p_toxic = toxic)::BIGINT, 0) AS correct,
    concat_ws(',', CASE WHEN p_quality <> quality THEN 'quality' END, CASE WHEN p_toxic <> toxic THEN 'toxic' END) AS wrong_fields
FROM ({_PREDICTED})
""")
def score_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "total", "correct", "wrong_fields")


_BOARD = f"""
SELECT coalesce(source, 'unknown') AS engine, count(*) AS pages, count(*) FILTER (WHERE labelled) AS labelled_pages,
    count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS error_pages, round(avg(length(coalesce(text, ''))), 2) AS avg_raw_text_chars,
    round(avg(CASE WHEN labelled THEN ((p_quality = quality)::INT + (p_toxic = toxic)::INT) / 2.0 END), 4) AS field_accuracy,
    sum(red)::BIGINT AS red, sum(yellow)::BIGINT AS yellow, sum(green)::BIGINT AS green, count(*) FILTER (WHERE has_id) AS national_ids
FROM ({_PREDICTED}) GROUP BY 1
"""


@query(_BOARD)
def flagship_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    board = rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("engine")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("total") > 0).alias("labelled_pages"),
        F.count_if("blank").alias("error_pages"),
        F.round(F.avg("chars"), 2).alias("avg_raw_text_chars"),
        scoring.mean(F.col("field_accuracy")).alias("field_accuracy"),
        *[F.sum(c).alias(c) for c in ("red", "yellow", "green")],
        F.count_if("has_id").alias("national_ids"),
    )
    return scoring.ranked(board)


@query("""
SELECT coalesce(event_type, 'unknown') AS engine, count(*) AS pages, count(*) FILTER (WHERE event_type = 'error') AS error_pages,
    round(avg(length(coalesce(props, ''))), 2) AS avg_raw_text_chars, round(avg(value), 4) AS avg_runtime_seconds FROM events GROUP BY 1
""")
def leaderboard_no_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return scoring.leaderboard(events, "event_type", F.when(F.col("event_type") == "error", F.col("event_type")), F.col("props"), {"avg_runtime_seconds": F.col("value")})


# --- documents of pages ----------------------------------------------------------------------------------------------


@query("""
SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant' AND coalesce(text, '') <> ''), arg_min(text, turn) FILTER (WHERE coalesce(text, '') <> '')) AS text
FROM conversations GROUP BY conv_id
""")
def best_value_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    status = F.when(F.col("role") == "assistant", F.lit("green")).otherwise(F.lit("yellow"))
    return turns.groupBy("conv_id").agg(packets.best(F.col("text"), status, F.struct("turn")).alias("text"))


@query("""
SELECT conv_id::VARCHAR AS source, min(turn)::VARCHAR AS document_id, count(*) AS page_count, string_agg(turn || ':' || role, ',' ORDER BY turn) AS pages,
    coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant' AND coalesce(text, '') <> ''), arg_min(text, turn) FILTER (WHERE coalesce(text, '') <> '')) AS subject
FROM conversations GROUP BY conv_id
""")
def document_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("role") == "assistant", F.lit("green")).otherwise(F.lit("yellow"))
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("document_id"), F.col("turn").cast("int").alias("page"), F.lit("").alias("file_name"),
        F.col("text").alias("subject"), "role", F.create_map(F.lit("subject"), F.struct(status.alias("status"), F.lit("").alias("message"))).alias("field_validation"),
    )
    made = packets.packets(pages, ("subject",))
    joined = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), p["role"])), ",")
    return made.select("source", F.col("document_id").cast("int").cast("string").alias("document_id"), "page_count", joined.alias("pages"), F.col("document_fields.subject").alias("subject"))


@query("SELECT event_id, user_id, event_type FROM events WHERE strftime(ts, '%Y%m%d') = (SELECT max(strftime(ts, '%Y%m%d')) FROM events)")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("run_id", F.date_format("ts", "yyyyMMdd"))
    return packets.latest_run(events).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, mode, length(text)::BIGINT AS chars FROM documents, (VALUES ('raw'), ('clean'), ('binarized')) AS m(mode)")
def cross_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row for each of three fixed modes: an explode of a literal, no join.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, ("raw", "clean", "binarized")))).alias("mode"), "chars")


@query(f"""
WITH t AS (SELECT conv_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 END AS p FROM conversations)
SELECT c.conv_id, coalesce(x.text, {quoted(merge.NO_TEXT)}) AS raw_text FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, arg_min(text, (p, text)) AS text FROM t WHERE p IS NOT NULL AND coalesce(text, '') <> '' GROUP BY conv_id) x USING (conv_id)
""")
def priority_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    texts = turns.select("conv_id", F.col("role").alias("engine"), "text")
    return merge.text_by_priority(turns.select("conv_id").distinct(), texts, ["conv_id"], ("assistant", "user")).select("conv_id", "raw_text")


@query(f"""
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'vlm-' || doc_id WHEN doc_id % 3 = 1 THEN '' END, {rule_sql('document_number')}) AS document_number FROM documents
""")
def merge_rules_vlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("vlm-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.lit(""))
    return docs.select("doc_id", merge.prefer(other, rules.field(F.col("text"), "document_number")).alias("document_number"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


_SPLIT = """
WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS n, count(*) OVER () AS c FROM s)
SELECT doc_id, source, CASE WHEN c > 1 AND n <= greatest(1, round_even(c * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM documents JOIN r USING (source)
"""


@query(_SPLIT)
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_by_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.1).select("doc_id", "source", "split")


@query(f"SELECT split, count(*) AS examples, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM ({_SPLIT}) GROUP BY split")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_train_val(spark, sf_dir)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("names"))


# --- review ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source AS engine FROM documents WHERE source = 'src1' AND lower(concat_ws(' ', doc_id, source, lang, text)) LIKE '%the%'")
def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("engine"), "lang", "text")
    return review.filtered(rows, engine="src1", search="THE").select("doc_id", "engine")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', doc_id, source, lang, 'STRASSE ' || lang, text)), 'strasse ' || 'de') OR source = 'src2'")
def review_search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search finds what differs in case only, of letters whose cases differ in length too."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("Stra\u00dfe "), "lang").alias("street"), "text")
    found = review.filtered(rows.drop("source"), search="STRA\u1e9eE DE").select("doc_id")
    return found.union(rows.where("source = 'src2'").select("doc_id")).distinct()


@query("SELECT count(*) AS pages, count(DISTINCT user_id) AS documents, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 2) AS mean_confidence FROM events")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return review.metrics(events.select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "error", F.lit("error")).alias("error"), F.col("value").alias("confidence")))


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y%m%d') = (SELECT max(strftime(ts, '%Y%m%d')) FROM events) UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def review_union_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("run_id", F.date_format("ts", "yyyyMMdd"))
    return packets.latest_run(events).select("event_id").unionAll(events.where("event_type = 'error'").select("event_id"))


# --- ingest and geometry ---------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT page_id, url, replace(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), ' ', '_') AS document_id FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY url, page_id) AS n FROM d)
SELECT page_id, CASE WHEN n > 1 THEN document_id || '_' || n ELSE document_id END AS document_id FROM r
""")
def doc_id_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folium.sources.files import document_id

    pages = table(spark, sf_dir, "pages").select("page_id", F.struct("url", "page_id").alias("place"), document_id(F.col("url")).alias("document_id"))
    return merge.unique_ids(pages, "document_id", "place").select("page_id", "document_id")


@query("SELECT NULL::VARCHAR AS engine, item_id AS id, length(text)::BIGINT AS chars FROM benchmark UNION ALL SELECT source, doc_id, NULL FROM documents")
def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("chars"))
    return merge.stacked(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("engine")))


# A box for each event: its corner by the event's value, its sides by the ids.
_BOXES_SQL = "(SELECT event_id AS k, value AS x, value / 2 AS y, (10 + user_id % 120)::DOUBLE AS w, (5 + event_id % 110)::DOUBLE AS h FROM events) AS b"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [(10 + F.col("user_id") % 120).cast("double").alias("w"), (5 + F.col("event_id") % 110).cast("double").alias("h")]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), *sides)


@query(f"SELECT k, trunc(x)::INT || ',' || trunc(y)::INT || ' ' || trunc(x + w)::INT || ',' || trunc(y)::INT || ' ' || trunc(x + w)::INT || ',' || trunc(y + h)::INT || ' ' || trunc(x)::INT || ',' || trunc(y + h)::INT AS polygon FROM {_BOXES_SQL}")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = geometry.xywh_to_polygon(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return _boxes(spark, sf_dir).select("k", F.array_join(F.transform(corners, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ").alias("polygon"))


@query(f"SELECT k, CASE WHEN abs(w - h) < greatest(w, h) * 0.45 THEN 'stamp' ELSE 'signature' END AS kind, w * h >= 700 AND w * h <= 40000 * 0.25 AS usable FROM {_BOXES_SQL}")
def region_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("k", geometry.region_kind(F.col("w"), F.col("h")).alias("kind"), geometry.usable_region(F.col("w") * F.col("h"), F.lit(40000.0)).alias("usable"))


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 5")
def limit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(table(spark, sf_dir, "pages").select("page_id", "url"), None, order=("url", "page_id"))


@query("SELECT page_id, 'stub' AS engine, strlen(html) || ' bytes' AS text, CASE WHEN html = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS avg_confidence FROM pages")
def ocr_stub_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("image"))
    return read_pages(pages, "stub").select("page_id", "engine", "text", "avg_confidence")


# The rest is registered by its import.
from folium.plans import files, records, scans  # noqa: E402, F401
