"""Exact dedup by a minimal perfect hash over the distinct digests of the historical rows.

Historical digests are dealt into buckets by their leading bits. Each bucket gets a minimal perfect hash (levels of bit
arrays with ranks); its slots hold the full SHA-256 digest and the winner's locator. Incoming rows are first reduced to
one row for each distinct digest, then looked up in their bucket: the digest in the slot is compared byte by byte, as a
perfect hash gives any stranger a slot too. Members merge with the historical winner; nonmembers are grouped separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, free_name, join_by_key, numbered, text_of, written

#: Distinct digests in a bucket, on average: some 2 MB of slots.
BUCKET = 20_000
GAMMA, LEVELS = 1.5, 48
_FOUND = "digest binary, member boolean, keep_id long, keep_row long, group_size long"


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8")


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot candidates of the digests at a level; each level mixes all words of the digest anew."""
    h = np.full(len(words), 0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1), "u8")
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct digests (rows of a uint8 matrix); slot() is -1 where a digest can't be a member."""

    def __init__(self, digests: np.ndarray):
        words, left = _words(digests), np.arange(len(digests))
        self.levels: list[np.ndarray] = []
        self.bases: list[np.ndarray] = []
        total = 0
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = _position(words[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            self.bases.append(total + np.cumsum(alone) - alone)
            total += int(alone.sum())
            left = left[~alone[at]]
        # What no level has placed (it would take astronomically unlucky digests) is kept in order behind the levels.
        self.rest = {digests[i].tobytes(): total + k for k, i in enumerate(left)}

    def slot(self, digests: np.ndarray) -> np.ndarray:
        words, out = _words(digests), np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, (bits, base) in enumerate(zip(self.levels, self.bases)):
            at = _position(words[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = base[at[hit]]
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32).copy()


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an id is null, and the ids as whole numbers of 64 bits (null: 0)."""
    return column.is_null().to_numpy(), pc.fill_null(column, 0).to_numpy()


def _look_up(rows: pa.Table) -> pa.Table:
    """One bucket: build the index over the historical digests, look up the incoming ones, return each distinct digest once."""
    history, incoming = rows.filter(rows["historical"]), rows.filter(pc.invert(rows["historical"]))
    old, new = _matrix(history["digest"]), _matrix(incoming["digest"])
    index = PerfectHash(old)
    slots = np.empty(len(old), np.int64)
    slots[index.slot(old)] = np.arange(len(old))  # the slot's digest and locator
    at = index.slot(new)
    known = at >= 0
    known[known] = (old[slots[at[known]]] == new[known]).all(axis=1)
    row = slots[at[known]]
    alone = np.ones(len(old), bool)
    alone[row] = False
    merged, past = incoming.filter(pa.array(known)), history.take(pa.array(row))
    # The longer original text wins, then the smaller doc_id (none: last), then the earlier row.
    past_wins, tied = np.zeros(len(row), bool), np.ones(len(row), bool)
    (a_none, a_id), (b_none, b_id) = _ids(merged["keep_id"]), _ids(past["keep_id"])
    order = [(-t["n_points"].to_numpy().astype(np.int64) for t in (merged, past)), (a_none, b_none), (a_id, b_id), (t["keep_row"].to_numpy() for t in (merged, past))]
    for a, b in order:
        past_wins |= tied & (b < a)
        tied &= a == b
    wins, total = pa.array(past_wins), pc.add(merged["group_size"], past["group_size"])
    merged = merged.set_column(merged.column_names.index("group_size"), "group_size", total)
    for c in ("keep_id", "keep_row"):
        merged = merged.set_column(merged.column_names.index(c), c, pc.if_else(wins, past[c], merged[c]))
    parts = [(merged, True), (incoming.filter(pa.array(~known)), False), (history.filter(pa.array(alone)), True)]
    out = pa.concat_tables(t.append_column("member", pa.array([member] * len(t), pa.bool_())) for t, member in parts)
    return out.select(["digest", "member", "keep_id", "keep_row", "group_size"])


def _grouped(rows: DataFrame, historical: Column) -> DataFrame:
    """One row for each distinct digest of either side: the winner's locator and the number of rows."""
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    return rows.groupBy("digest", historical.alias("historical")).agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", "historical", (-F.col("w.a")).alias("n_points"), F.col("w.c").alias("keep_id"), F.col("w.d").alias("keep_row"), "group_size"
    )


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, in UTF-8."""
    return F.unhex(F.sha2(F.regexp_replace(text, "[ \\t-\\r]+", "").cast("binary"), 256))


def mark_duplicates(rows: DataFrame, historical: Column, buckets: int | None = None) -> DataFrame:
    """Decide which of equal rows stays.

    rows has digest (32 bytes), n_points, doc_id and row (a number that is unique to each row); historical says which rows
    the index is built over, the others are looked up. Adds keep_id, group_size, member (the digest is in the index) and
    kept. Rows that repeat a doc_id and text are told apart by row, so exactly one row of a group is kept. A null doc_id
    loses against any other. An empty table gives an empty result.
    """
    if buckets is None:
        buckets = 1 + rows.select(F.approx_count_distinct("digest")).first()[0] // BUCKET
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    found = _grouped(rows, historical).groupBy(bucket.alias("bucket")).applyInArrow(_look_up, _FOUND)
    found = written(found, "winners")
    return join_by_key(rows, found, "digest", "group_size").withColumn("kept", F.col("row") == F.col("keep_row"))


def _rows(docs: DataFrame) -> DataFrame:
    """The texts are read once: what follows works on a thin table. docs has doc_id, text and row."""
    return written(docs.select("doc_id", "row", F.length(text_of()).alias("n_points"), digest_of(text_of()).alias("digest")), "digests")


def _historical() -> Column:
    """Stands for what earlier deliveries have brought: half of the rows. Any split gives the same groups and winners."""
    return F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit(True))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and member, a row for each document.

    Null counts as empty text; all empty texts are one group.
    """
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"), "folium_row").withColumnRenamed("folium_row", "row")
    marked = mark_duplicates(_rows(docs), _historical())
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "member")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    row = free_name(docs, "folium_row")
    all_ = numbered(docs, row)  # once: a second numbering of rows that don't come from files may differ
    thin = all_.select("doc_id", "text", F.col(row).alias("row"))
    lost = mark_duplicates(_rows(thin), _historical()).where(~F.col("kept"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row"))
    return all_.join(lost, (all_[row] == lost["lost_row"]) & all_["doc_id"].eqNullSafe(lost["lost_id"]), "left_anti").drop(row)
