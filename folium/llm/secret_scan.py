"""Secret scans with corpus-wide ownership.

Base patterns give spans. Every candidate's value is hashed; hashes are counted by distinct repositories and owners over
the whole corpus. A value that many owners hold, or that is spread over many repositories, is a copied example; a value of
one owner and one repository that looks random is a live-looking credential; a random-looking value between the two (of two
owners, or of a few repositories) is shared. The verdicts are added as spans beside the base ones.

All of it is DataFrame functions: positions come from the lengths of what split() leaves between the matches that
regexp_extract_all() returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, join_by_key, numbered, text_of, written

# Fixed patterns of the base spans: kind, pattern, group of the value, its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: A value that so many owners or so many repositories hold is an example; others look random with so many distinct characters, and a digit.
SHARED_BY, SPREAD, RANDOM_CHARS = 3, 4, 10


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a kind: array of struct(start, kind number, end, value), failing ones dropped."""
    # Runs of one class are maximal, so only runs that are long enough need to be found; an assignment that fails still uses up its text.
    if kind == "hex":
        pattern = r"[0-9a-f]{%d,}" % least
    elif kind == "access":
        pattern = r"AKIA[A-Z0-9]{%d,}" % (least - 4)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    # (length of the gap before, length of the match, value), then a running sum.
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), values.alias("v")), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m["w"]).alias("n"), m["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    summed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["g"] + s["n"]).alias("at"),
            F.when(F.length(s["v"]) >= least, F.concat(a["out"], F.array(F.struct((a["at"] + s["g"]).alias("start"), F.lit(order).alias("kind"), (a["at"] + s["g"] + s["n"]).alias("end"), s["v"].alias("value"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), summed).otherwise(none)


def _joined(spans: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """The base spans of each document: row, doc_id, owner, repository, found (array of start, kind, end, value)."""
    text = numbered(docs.select("doc_id", text_of().alias("t"), owner.alias("owner"), repository.alias("repository")), "row")
    found = F.concat(*[_spans(F.col("t"), k, *kind) for k, kind in enumerate(KINDS)])
    return text.select("row", "doc_id", "owner", "repository", found.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """By candidate hash: how many rows, distinct repositories and distinct owners hold it.

    Copies within one repository are summed before anything meets at the hash, so a value in a third of all rows is as
    many rows there as it has repositories. A null owner or repository counts as one of its own.
    """
    held = found.select("owner", "repository", F.explode("found.value").alias("value")).select(F.sha2("value", 256).alias("hash"), "owner", "repository")
    held = held.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = held.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


#: Kinds that the method adds, after the base ones.
ADDED = ("example", "live", "shared")


def judge(found: DataFrame) -> DataFrame:
    """found with added: for each base span whose value gets a verdict a span of it.

    Of SHARED_BY owners or more, or SPREAD repositories or more: example. Of others that look random: live, if one repository
    of one owner has it, else shared. Other values get none.
    """
    held = written(ownership(found), "ownership")
    distinct = F.size(F.array_distinct(F.split(F.col("s.value"), "")))
    each = found.select("row", "doc_id", F.explode("found").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    random = (distinct >= RANDOM_CHARS) & F.col("s.value").rlike("[0-9]")
    spread = (F.col("n_owners") >= SHARED_BY) | (F.col("n_repositories") >= SPREAD)
    verdict = F.when(spread, F.lit(len(KINDS))).when(random & (F.col("n_repositories") == 1), F.lit(len(KINDS) + 1)).when(random, F.lit(len(KINDS) + 2))
    added = join_by_key(each, held, "hash", "n_rows").select("row", "doc_id", F.struct(F.col("s.start").alias("start"), verdict.alias("kind"), F.col("s.end").alias("end")).alias("a")).where(F.col("a.kind").isNotNull())
    added = added.groupBy("row", "doc_id").agg(F.collect_set("a").alias("added"))
    same_row = (found["row"] == added["row"]) & found["doc_id"].eqNullSafe(added["doc_id"])
    return found.join(added, same_row, "left").select(found["*"], F.coalesce(added["added"], F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live and n_shared for each document.

    The owner of a document is its source, its repository the source's part in one language. Null and empty texts have
    no spans: zero counts, an empty spans string and the hash of an empty string.
    """
    docs = documents(spark, sf_dir)
    found = written(scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")), "secrets")
    judged = judge(found)
    names = (*[k[0] for k in KINDS], *ADDED)
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    counts = [_count("found", k).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    more = [_count("added", k + len(KINDS)).alias(f"n_{name}") for k, name in enumerate(ADDED)]
    return judged.select("doc_id", *counts, F.sha2(_joined(base, names), 256).alias("base_sha256"), _joined(F.concat(base, "added"), names).alias("spans"), *more)
