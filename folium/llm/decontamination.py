"""Benchmark decontamination by canonical templates.

Numbers, names and units are replaced with typed placeholders, in items and documents alike. Windows of WINDOW canonical
words are hashed and joined; a document and an item that share windows at the same distance between their positions lie on
one diagonal. Along a diagonal the words behind the placeholders are compared: where an item says the same twice, so must
the document, or the pair is no re-parameterised copy of the item. Where placeholders are nearly all that matches (a list
of numbers beside another), only what is the same word for word counts. A diagonal that covers COVERED of an item's words,
or RUN words, flags the document.

Items are told apart by their row, so item_ids may be null or repeat: an item without an id flags documents too, and items
that share an id count as one in n_items but never lend each other their words or slots.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import bound
from folium.llm.common import documents, free_name, numbered, text_of, written

WINDOW, COVERED, RUN = 8, 0.5, 13
#: Rows of benchmark windows that are broadcast at most; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Words of a diagonal that are no placeholders, at least; of all its words also a third.
LITERAL = 3
# Words that are numbers (those that are other words too are left out).
NUMBERS = (
    "two three four five seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze quinze vingt cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte cien mil"
).split()
# Units that follow a number, also glued to it; and units in words, whose plural has an s or es.
GLUED = "kg|g|mg|km|m|cm|mm|l|ml|h|min|s|usd|eur|kwh|mph|kmh|lb|lbs|oz|ft|in|yd|mi|gb|mb|kb|tb|hz|khz|mhz|ghz|w|kw|mw|v|a|j|kj|cal|kcal|k|pm|am"
NAMED = (
    "second minute hour day week fortnight month year decade century sekunde minute stunde tag woche monat jahr seconde heure jour semaine mois an année segundo minuto hora día semana mes año "
    "meter metre kilometer kilometre centimeter centimetre millimeter millimetre inch foot yard mile league furlong mètre kilomètre metro kilómetro meile "
    "gram gramme kilogram milligram pound ounce ton tonne stone carat gramm kilogramm pfund kilo gramo tonelada "
    "liter litre milliliter millilitre gallon quart pint cup teaspoon tablespoon barrel bushel hectoliter litro liter "
    "dollar cent euro penny pence quid rupee yen yuan peso franc mark real ruble rouble krona krone dinar dirham pesos dólar "
    "degree percent watt kilowatt volt ampere joule calorie kilocalorie newton pascal hertz byte kilobyte megabyte gigabyte terabyte bit acre hectare dozen pair piece box bag bottle page"
).split()
IRREGULAR = ("feet", "inches", "pennies", "centuries")
UNITS = GLUED + "|" + "|".join(rf"{w}(?:s|es|n|en)?" for w in sorted({*NAMED, *IRREGULAR}))
#: The same as whole words, for those behind a number that is a word.
UNIT_WORDS = sorted({*GLUED.split("|"), *IRREGULAR, *(w + end for w in NAMED for end in ("", "s", "es", "n", "en"))})
#: Around capitalised words at the start of a sentence or line, or behind a quote or bracket (characters for private use, which are no words).
BEGIN, END = "\ue000", "\ue001"
#: Between capitalised words in a row, which are one name.
JOIN = "\ue002"
#: The most frequent words of the items that don't begin with a capital letter, as many as this at most: at the start of a sentence these are themselves, others are names.
COMMON = 20_000


def _where(test: Column, text: Column, pattern: str, new: str) -> Column:
    return F.when(test, F.regexp_replace(text, pattern, new)).otherwise(text)


def _spaced(text: Column) -> Column:
    """The text with a space between a number and the unit that is glued to it, and capitalised words in a row as one."""
    # Patterns begin with the character that is rarest and look back from it: what they start with is tried at every place.
    joined = F.regexp_replace(text, r"(\p{Lu}(?<![\p{L}\p{M}\d]\p{Lu})[\p{L}\p{M}]*)\x20(?=\p{Lu})", f"$1{JOIN}")
    return _where(text.rlike("[0-9]"), joined, rf"(?i)(\d(?<![\p{{L}}\d][.,]?\d)[\d.,]*)(?=(?:{GLUED})(?![\p{{L}}\d]))", "$1 ")


def _canonical(spaced: Column) -> Column:
    """The text with typed placeholders and without marks, its white space as it was; capitalised words elsewhere stand in BEGIN and END.

    Numbers, units behind numbers, and capitalised words inside a sentence as names.
    """
    digits = spaced.rlike("[0-9]")
    names = F.regexp_replace(spaced, rf"\p{{Lu}}(?<=[\p{{L}}\d,;]\x20\p{{Lu}})[\p{{L}}\p{{M}}{JOIN}]*", "<name>")
    capitals = F.regexp_replace(names, rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\d]\p{{Lu}})[\p{{L}}\p{{M}}{JOIN}]*", f"{BEGIN}$0{END}")
    numbers = _where(digits, capitals, r"\d(?<![\p{L}\d][.,]?\d)[\d.,]*(?![\p{L}\d])", "<num>")
    units = _where(digits, F.lower(numbers), rf"(?<=<num>\x20?)(?:{UNITS})(?![\p{{L}}\d])", "<unit>")
    return F.regexp_replace(units, rf"[^a-z\x20\p{{L}}\p{{M}}\d<>\x09-\x0D{BEGIN}{END}{JOIN}]+", "")


def _tokens(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def _typed(word: Column, common: list[str]) -> Column:
    """A canonical word: numbers as words are typed, and capitalised ones that aren't common are names."""
    plain = F.replace(F.replace(word, F.lit(BEGIN), F.lit("")), F.lit(END), F.lit(""))
    capital = F.when(word.startswith(BEGIN) & ~plain.isin(*common) & ~plain.isin(*NUMBERS), F.lit("<name>")).when(plain.isin(*NUMBERS), F.lit("<num>")).otherwise(plain)
    return F.when(F.contains(word, F.lit(BEGIN)), capital).when(word.isin(*NUMBERS), F.lit("<num>")).otherwise(word)


def common_words(benchmark: DataFrame) -> list[str]:
    """The most frequent lower-case words of the items: whether a word at the start of a sentence is a name depends on these alone, for items and documents alike."""
    words = benchmark.select(F.explode(_tokens(_canonical(_spaced(text_of())))).alias("w")).where(~F.contains("w", F.lit(BEGIN)) & F.col("w").rlike(r"^[\p{L}\p{M}]+$"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(COMMON).collect()]


def slotted(text: Column, common: list[str]) -> Column:
    """The canonical words with what stands behind each: array of struct(canon, raw)."""
    spaced = _spaced(text)
    # Marks at the ends don't tell values apart, but signs and currencies do.
    raw = F.transform(_tokens(F.lower(spaced)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{M}\d\p{Sc}%+\u2212-]+|[^\p{L}\p{M}\d\p{Sc}%]+$", ""))
    canon = F.transform(_tokens(_canonical(spaced)), lambda w: _typed(w, common))
    whole = F.filter(F.arrays_zip(canon.alias("canon"), raw.alias("raw")), lambda p: p["canon"] != "")
    return bound(whole, lambda ps: F.transform(ps, lambda p, i: F.struct(_measured(p["canon"], F.get(ps, i - 1)["canon"]).alias("canon"), p["raw"].alias("raw"))))


def _measured(word: Column, prior: Column) -> Column:
    """A unit behind a number is typed; behind digits it is already."""
    return F.when((prior == "<num>") & word.isin(*UNIT_WORDS), F.lit("<unit>")).otherwise(word)


def _hashes(text: Column, common: list[str]) -> Column:
    """Hashes of the canonical words of a canonical text."""
    typed = F.transform(F.filter(_tokens(text), lambda w: w != ""), lambda w: _typed(w, common))
    return bound(typed, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(_measured(w, F.get(ws, i - 1)))))


def _windows(words: Column, sizes: list[int]) -> Column:
    """pos and h of each window of these sizes."""

    def of(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words, i + 1, size), F.lit(size)).alias("h")))
        return F.when(F.size(words) >= size, every).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))

    return of(sizes[0]) if len(sizes) == 1 else F.concat(*map(of, sizes))


def items_of(benchmark: DataFrame, common: list[str]) -> DataFrame:
    """item (its row), item_id, words (hashes), raws, n_words, size (of the windows; the whole item where it is shorter) and slots (pos and raw)."""
    each = numbered(benchmark.select("item_id", "text"), "item").select("item", "item_id", slotted(text_of(), common).alias("s"))
    every = F.transform("s", lambda p, i: F.struct(i.alias("pos"), p["raw"].alias("raw"), p["canon"].rlike("<(num|name|unit)>").alias("slot")))
    slots = F.transform(F.filter(every, lambda p: p["slot"]), lambda p: F.struct(p["pos"].alias("pos"), p["raw"].alias("raw")))
    each = each.select("item", "item_id", F.transform("s.canon", lambda w: F.xxhash64(w)).alias("words"), F.col("s.raw").alias("raws"), slots.alias("slots")).where(F.size("words") > 0)
    return each.select("item", "item_id", "words", "raws", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(WINDOW)).alias("size"), "slots")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast, if it is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, item, item_id, covered (share of the item's words) and longest (words in a row) for each document and item that match.

    docs has doc_id, text and row. Items or documents without words match nothing.
    """
    common = common_words(benchmark)
    items = written(items_of(benchmark, common), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [WINDOW]  # 1 to WINDOW
    grams = items.where(F.col("size") == sizes[0]).select("item", "size", F.explode(_windows(F.col("words"), sizes[:1])).alias("w"))
    for k in sizes[1:]:
        grams = grams.unionAll(items.where(F.col("size") == k).select("item", "size", F.explode(_windows(F.col("words"), [k])).alias("w")))
    grams = written(grams.select("item", "size", F.col("w.pos").alias("at"), "w.h"), "item-windows")
    marked = docs.select("row", "doc_id", _canonical(_spaced(text_of())).alias("marked"))
    each = marked.select("row", "doc_id", _hashes(F.col("marked"), common).alias("words"))
    each = each.select("row", "doc_id", F.explode(_windows(F.col("words"), sizes)).alias("w")).select("row", "doc_id", "w.pos", "w.h")
    hits = each.join(_sized(grams, grams.count()), "h")
    # On a diagonal; its windows are at most as many as the item's.
    lines = hits.groupBy("row", "doc_id", "item", "size", (F.col("pos") - F.col("at")).alias("shift")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    lines = written(lines, "diagonals").join(F.broadcast(items) if items.count() <= BROADCAST_ROWS // 20 else items, ["item", "size"]).drop("words")
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1)))))
    lines = lines.withColumn("spots", spots)
    lines = lines.withColumn("slots", F.filter("slots", lambda s: F.array_contains("spots", s["pos"])))
    literal = F.size("spots") - F.size("slots")
    lines = lines.withColumn("bare", (literal < F.least(F.lit(LITERAL), F.size("spots"))) | (literal * 3 < F.size("spots")))
    # Only where an item repeats a slot's word is there something to compare, or where there is little else than slots.
    again = F.col("bare") | (F.size("slots") > F.size(F.array_distinct(F.transform("slots", lambda s: s["raw"]))))
    doubt = lines.where(again)
    few = written(doubt, "slots-in-doubt")
    wanted = few.select("row", "doc_id").distinct()
    texts = docs.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "text").join(_sized(wanted, few.count()), (F.col("r") == F.col("row")) & F.col("d").eqNullSafe(F.col("doc_id")), "left_semi")
    texts = written(texts, "texts-in-doubt").select("r", "d", slotted(text_of(), common)["raw"].alias("theirs"))
    pairs = F.transform("slots", lambda s: F.struct(s["raw"].alias("i"), F.get(F.col("theirs"), s["pos"] + F.col("shift")).alias("d")))
    checked = few.join(texts, (F.col("r") == F.col("row")) & F.col("d").eqNullSafe(F.col("doc_id"))).withColumn("pairs", F.array_distinct(pairs))
    same = F.filter("spots", lambda p: F.get(F.col("raws"), p).eqNullSafe(F.get(F.col("theirs"), p + F.col("shift"))))
    checked = written(checked.withColumn("same", same), "slots-compared")
    values = F.array_distinct(F.transform("pairs", lambda p: p["i"]))
    consistent = ~F.col("bare") & (F.size("pairs") == F.size(values))
    # Else what is verbatim counts, where the document quotes a window of the item or still has each value that it changes once.
    quoted = F.exists("same", lambda a: F.size(F.filter("same", lambda b: (b >= a) & (b < a + WINDOW))) == WINDOW)
    edited = F.forall(values, lambda v: (F.size(F.filter("pairs", lambda p: p["i"] == v)) == 1) | F.exists("pairs", lambda p: (p["i"] == v) & p["d"].eqNullSafe(v)))
    cols = ["row", "doc_id", "item", "item_id", "n_words"]
    told = checked.withColumn("spots", F.when(consistent, F.col("spots")).when(quoted | edited, F.col("same"))).where(F.size("spots") > 0)
    good = lines.where(~again).select(*cols, "spots").unionAll(told.select(*cols, "spots"))
    # Words in a row: spots less their places fall into runs.
    runs = F.transform("spots", lambda p, i: p - i)
    longest = F.array_max(F.transform(F.array_distinct(runs), lambda k: F.size(F.filter(runs, lambda x: x == k))))
    good = good.withColumn("longest", longest)
    merged = good.groupBy("row", "doc_id", "item", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("n"), F.max("longest").alias("longest"), F.max("n_words").alias("n_words"))
    return merged.select("row", "doc_id", "item", "item_id", (F.col("n") / F.col("n_words")).alias("covered"), "longest").where((F.col("covered") >= COVERED) | (F.col("longest") >= RUN))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, items (sorted array of the ids), n_items (distinct ids, none as one of its own) and covered (the largest share) of the flagged documents; docs has doc_id, text and row."""
    found = find(docs, benchmark)
    n = F.count_distinct(F.struct("item_id")).alias("n_items")
    return found.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), n, F.max("covered").alias("covered"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (comma-joined, ascending) and covered for each document.

    Null and empty texts match nothing, nor does any text of an empty table; an empty benchmark flags nothing. Each row is judged by itself, whatever its doc_id.
    Items without an id count in contaminated, n_items and covered, and have no place in item_ids.
    """
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"), "folium_row").select("doc_id", "text", F.col("folium_row").alias("row"))
    found = flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "items", "n_items", "covered")
    out = docs.select("row", "doc_id").join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit("")).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't flagged, with their own columns."""
    row = free_name(docs, "folium_row")
    every = numbered(docs, row)
    found = flag(every.select("doc_id", "text", F.col(row).alias("row")), benchmark)
    found = found.select(F.col("row").alias("bad_row"), F.col("doc_id").alias("bad_id"))
    return every.join(found, (every[row] == found["bad_row"]) & every["doc_id"].eqNullSafe(found["bad_id"]), "left_anti").drop(row)
