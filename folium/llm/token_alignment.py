"""Alignment of two tokenizers over the same texts, by interval joins of DuckDB inside of Arrow partitions.

Texts are cut at single spaces, which no token of either goes on over, so each distinct word of a chunk is aligned once. The
words become two interval tables, one for each tokenizer: a token's id and the bytes from where to where it stands. An ASOF join finds the first A token that a B token overlaps, a range join the others that it reaches over. Overlaps
that end together are links; the running sum of these ends numbers the groups of tokens between them. Every partition keeps
counts of its id pairs and gives them out with its documents; Spark merges them and scores the documents' links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folium.llm.common import documents, join_by_key, written
from folium.llm.token_blocks import ByteBpe, _chunks

#: Tokens of A that DuckDB takes at once; longer texts are cut where tokens of both end.
SLICE = 1 << 20
#: Distinct id pairs that a partition holds before it gives their counts out.
HELD_PAIRS = 1 << 20
#: Pair counts are broadcast up to this many, 17 bytes each; beyond it documents' pairs meet them in a join.
BROADCAST_PAIRS = 2_000_000
#: Words that a worker remembers, and their characters.
HELD_WORDS, HELD_CHARACTERS = 300_000, 1 << 22
_ID = 32  # a pair is A's id and, in so many bits, B's
_ROWS = "doc_id long, partial boolean, n_a long, n_b long, n_groups long, n_overlaps long, groups string, pairs array<long>, times array<long>"


_CUT, _DOUBLE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def _cut(text: str) -> list[str]:
    """What stands between single spaces that have no other white space beside them."""
    return _CUT.split(text) if text[0].isspace() or text[-1].isspace() or _DOUBLE.search(text) else text.split(" ")


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePieces:
    """A byte-level BPE of the tokenizers library over texts with a space before them; added tokens' strings are plain text."""

    #: Whether no token goes on over a single space between two words.
    cuts = True

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.bpe.tokenizer.encode_special_tokens = True
        of, vocab = byte_level(), self.bpe.tokenizer.get_vocab()
        added = {t.content for t in self.bpe.tokenizer.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in added:
                self.bytes[i] = bytes(of[c] for c in token)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated ids, and how many each text has."""
        if any(t[:1] == "\n" for t in texts):
            return self.bpe._texts([" " + t for t in texts])
        return self.bpe._pieces(texts)


class SpacedPieces:
    """A model of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.cuts = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode())
                self.cuts &= "▁" not in piece.lstrip("▁")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(texts, num_threads=1)
        sizes = np.array([len(x) for x in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())), sizes


_OVERLAPS = """
CREATE OR REPLACE TEMP TABLE firsts AS SELECT b.id AS b, b.e AS b_end, a.id AS a, a.e AS a_end FROM b_tokens b ASOF JOIN a_tokens a ON a.s <= b.s;
CREATE OR REPLACE TEMP TABLE others AS
    SELECT f.b, f.b_end, a.id AS a, a.e AS a_end FROM (SELECT * FROM firsts WHERE a_end < b_end) f JOIN a_tokens a ON a.s >= f.a_end AND a.s < f.b_end;
CREATE OR REPLACE TEMP TABLE links AS
    SELECT a_end AS e, (a::BIGINT << 32) | b AS pair FROM (FROM firsts UNION ALL FROM others) WHERE a_end = b_end;
"""
_GROUPS = """
CREATE OR REPLACE TEMP TABLE numbered AS SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS g FROM links;
SELECT 0 AS side, t.id, t.e, n.g FROM a_tokens t ASOF JOIN numbered n ON t.e <= n.e
UNION ALL SELECT 1, t.id, t.e, n.g FROM b_tokens t ASOF JOIN numbered n ON t.e <= n.e
"""


class Joins:
    """A DuckDB connection of one task: one thread, bounded memory, nothing on disk."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.execute("CREATE TEMP TABLE counted (pair BIGINT, n BIGINT)")
        self.held = 0

    def align(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """a, b: ids and ends of tokens over the same bytes from 0 on.

        Gives tokens of both in the order of their groups (side 0 or 1, id, end, group), links (end and pair) and the ends of
        the B tokens of all overlaps.
        """
        for name, (ids, ends) in (("a_tokens", a), ("b_tokens", b)):
            table = pa.table({"id": ids.astype(np.int32), "s": np.concatenate([[0], ends[:-1]]), "e": ends})
            self.con.register("arrow_tokens", table)
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_tokens")
            self.con.unregister("arrow_tokens")
        self.con.execute(_OVERLAPS)
        tokens = self.con.execute(_GROUPS).fetchnumpy()
        links = self.con.execute("SELECT e, pair FROM links ORDER BY e").fetchnumpy()
        over = self.con.execute("SELECT b_end FROM firsts UNION ALL SELECT b_end FROM others").fetchnumpy()["b_end"]
        order = np.lexsort((tokens["e"], 2 * tokens["g"] + tokens["side"]))
        return {k: tokens[k][order] for k in ("side", "id", "e", "g")} | {"link_e": links["e"], "pair": links["pair"], "over": over}

    def count(self, pairs: pa.Array, times: pa.Array) -> bool:
        """Add to the counts of pairs; whether there are so many different ones that the counts should go out."""
        self.con.register("arrow_pairs", pa.table({"pair": pairs, "n": times}))
        self.con.execute("INSERT INTO counted SELECT pair, sum(n) FROM arrow_pairs GROUP BY pair")
        self.con.unregister("arrow_pairs")
        size = "SELECT count(*) FROM counted"
        if self.con.execute(size).fetchall()[0][0] <= 2 * HELD_PAIRS:
            return False
        self.con.execute("CREATE OR REPLACE TEMP TABLE counted AS SELECT pair, sum(n)::BIGINT AS n FROM counted GROUP BY pair")
        return self.con.execute(size).fetchall()[0][0] > HELD_PAIRS

    def counts(self) -> dict[str, np.ndarray]:
        """The counts of all pairs since the last call."""
        got = self.con.execute("SELECT pair, sum(n)::BIGINT AS n FROM counted GROUP BY pair ORDER BY pair").fetchnumpy()
        self.con.execute("DELETE FROM counted")
        return got


def _slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Places in the ends of both, some SLICE tokens of A apart, where both have a token's end: from, to in a, from, to in b."""
    i = j = 0
    while i < len(a):
        k = min(i + SLICE, len(a)) - 1
        while (m := int(np.searchsorted(b, a[k]))) >= len(b) or b[m] != a[k]:
            k += 1
        yield i, k + 1, j, m + 1
        i, j = k + 1, m + 1


def _rows(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Words:
    """The alignment of words, each with a space before it: no token of either side goes on over a single space between two.

    Words that are new in a chunk are aligned together; what a worker remembers is bounded, beyond that it starts anew.
    """

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
        # A token's text with what follows it: another of its side, the other side, the next group, nothing.
        self.shown = [[f"{i}{mark}" for i in range(max(len(a.bytes), len(b.bytes)))] for mark in (",", "|", ";", "")]
        self.cut = _cut if a.cuts and b.cuts else lambda text: [text]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.characters = 0
        #: By word: whether both sides give it back, tokens of A and B, overlaps, links; groups as text; where its pairs start.
        self.facts = np.zeros((0, 5), np.int64)
        self.texts: list[str] = []
        self.first = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def learn(self, words: set[str], joins: Joins) -> None:
        new = [w for w in words if w not in self.index]
        more = sum(map(len, new))
        if len(self.index) + len(new) > HELD_WORDS or self.characters + more > HELD_CHARACTERS:
            self.clear()
            new = list(words)
            more = sum(map(len, new))
        if not new:
            return
        self.characters += more
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        facts, texts, pairs = self._aligned(new, joins)
        self.first = np.append(self.first, len(self.pairs) + np.cumsum(facts[:, 4]) - facts[:, 4])
        self.pairs = np.append(self.pairs, pairs)
        self.facts = np.concatenate([self.facts, facts])
        self.texts += texts

    def _aligned(self, words: list[str], joins: Joins) -> tuple[np.ndarray, list[str], np.ndarray]:
        """facts, groups and all pairs of words that are given once each."""
        facts = np.zeros((len(words), 5), np.int64)
        ids, counts = zip(*(t.encode(words) for t in (self.a, self.b)))
        own = [" " + w for w in words]
        whole = [w.encode("utf-8", "surrogatepass") for w in own]
        given = []
        for t, i, n in zip((self.a, self.b), ids, counts):
            parts, upto = list(map(t.bytes.__getitem__, i.tolist())), np.cumsum(n).tolist()
            given.append([b"".join(parts[x:y]) == w for x, y, w in zip([0, *upto], upto, whole)])
        facts[:, 0] = np.logical_and(*given)
        good = facts[:, 0] > 0
        ids = [i[np.repeat(good, n)] for i, n in zip(ids, counts)]
        facts[:, 1], facts[:, 2] = counts[0] * good, counts[1] * good
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        found = {k: [np.zeros(0, np.int64)] for k in ("side", "id", "e", "g", "link_e", "pair", "over")}
        groups = 0
        for i, i2, j, j2 in _slices(*ends):
            base = ends[0][i - 1] if i else 0
            got = joins.align((ids[0][i:i2], ends[0][i:i2] - base), (ids[1][j:j2], ends[1][j:j2] - base))
            for k, by in (("e", base), ("link_e", base), ("over", base), ("g", groups)):
                got[k] = got[k] + by
            groups = int(got["g"][-1]) + 1
            for k, v in got.items():
                found[k].append(v)
        all_ = {k: np.concatenate(v) for k, v in found.items()}
        end = np.cumsum(np.array([len(w) for w in whole], np.int64) * good)
        upto = lambda places: np.diff(np.concatenate([[0], np.searchsorted(places, end, "right")]))
        facts[:, 3], facts[:, 4] = upto(np.sort(all_["over"])), upto(all_["link_e"])
        return facts, self._texts(all_, np.cumsum(facts[:, 1] + facts[:, 2])), all_["pair"]

    def _texts(self, found: dict[str, np.ndarray], upto: np.ndarray) -> list[str]:
        """Each word's groups as text."""
        side, group, ids = found["side"], found["g"], found["id"].tolist()
        mark = np.zeros(len(ids), np.int64)
        if len(ids):
            mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
            mark[np.unique(upto[upto > 0]) - 1] = 3
        shown = self.shown
        parts = [shown[m][i] for m, i in zip(mark.tolist(), ids)]
        return ["".join(parts[x:y]) for x, y in zip([0, *upto.tolist()], upto.tolist())]


class Aligner:
    def __init__(self, words: Words):
        self.words, self.joins = words, Joins()

    def chunk(self, doc_ids: list, texts: list[str]) -> tuple[pa.RecordBatch, bool]:
        """The rows of some documents; and whether partial() should follow."""
        words = self.words
        split = [words.cut(t) if t else [] for t in texts]
        words.learn(set(chain.from_iterable(split)), self.joins)
        sizes = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(words.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(words.facts[at], axis=0)])
        facts = sums[ends] - sums[ends - sizes]
        good = facts[:, 0] == sizes  # every word comes back byte for byte
        facts[~good] = 0
        shown = list(map(words.texts.__getitem__, at.tolist()))
        groups = [";".join(shown[e - n : e]) if g else "" for e, n, g in zip(ends.tolist(), sizes.tolist(), good.tolist())]
        at = at[np.repeat(good, sizes)]
        pairs, times, offsets = _distinct(words.pairs[_rows(words.first[at], words.facts[at, 4])], facts[:, 4])
        batch = {
            "doc_id": pa.array(doc_ids, pa.int64()), "partial": pa.array(np.zeros(len(texts), bool)), "n_a": pa.array(facts[:, 1]), "n_b": pa.array(facts[:, 2]), "n_groups": pa.array(facts[:, 4]),
            "n_overlaps": pa.array(facts[:, 3]), "groups": pa.array(groups, pa.string()), "pairs": pa.ListArray.from_arrays(offsets, pairs), "times": pa.ListArray.from_arrays(offsets, times),
        }
        return pa.RecordBatch.from_pydict(batch), self.joins.count(pairs, times)

    def partial(self) -> pa.RecordBatch:
        """A row of pair counts, of no document."""
        got = self.joins.counts()
        whole = pa.array(np.array([0, len(got["pair"])], np.int32))
        row = {c: pa.array([None], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_overlaps")}
        row |= {"partial": pa.array([True]), "groups": pa.array([None], pa.string()), "pairs": pa.ListArray.from_arrays(whole, pa.array(got["pair"].astype(np.int64))), "times": pa.ListArray.from_arrays(whole, pa.array(got["n"].astype(np.int64)))}
        return pa.RecordBatch.from_pydict({c: row[c] for c in ("doc_id", "partial", "n_a", "n_b", "n_groups", "n_overlaps", "groups", "pairs", "times")})


def _distinct(pair: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The distinct pairs of each document, how often it has them, and where its list starts."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(sizes)))]).astype(np.int32)
    return pa.array(pair[at].astype(np.int64)), pa.array(np.diff(np.append(at, len(pair)))), pa.array(offsets)


_WORDS: dict[tuple[str, str], Words] = {}


def shared_words(a: str, b: str) -> Words:
    """One memory for each worker."""
    if (a, b) not in _WORDS:
        _WORDS.clear()
        _WORDS[a, b] = Words(BytePieces(a), SpacedPieces(b))
    return _WORDS[a, b]


class Alignment(NamedTuple):
    #: doc_id, n_a, n_b, n_groups, n_overlaps, groups, pairs, times: a row for each document; a pair is a << 32 | b.
    documents: DataFrame
    #: pair, n (links of the corpus that hold it), best (whether no other pair of its B id has more): a row for each pair.
    counts: DataFrame


def align(docs: DataFrame, a: str, b: str, kept: Callable[[Column], Column] = lambda groups: groups) -> Alignment:
    """Align a byte-level BPE, a, and a sentencepiece model, b, over all texts.

    groups is a text `a1,a2|b1;a3|b2,b3`, of which kept() says what is stored. Texts that are null, empty, or that either
    tokenizer doesn't give back byte for byte have no tokens. Rows may repeat ids and texts; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared_words(a, b))
        for doc_ids, texts in _chunks(batches):
            rows, full = aligner.chunk(doc_ids, texts)
            yield rows
            if full:
                yield aligner.partial()
        yield aligner.partial()

    rows = docs.select("doc_id", "text").mapInArrow(scan, _ROWS)
    table = written(rows.withColumn("groups", kept(F.col("groups"))), "aligned")
    partial = table.where("partial").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = written(counts, "pairs")
    b_id = F.col("pair").bitwiseAND((1 << _ID) - 1).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return Alignment(table.where("NOT partial").drop("partial"), counts)


def scored(alignment: Alignment) -> DataFrame:
    """The documents with n_links, n_best (links whose pair is the best of its B id) and count_sum (the sum of their pairs' counts) in place of pairs and times."""
    docs, counts = alignment.documents, written(alignment.counts, "counts")
    if counts.count() > BROADCAST_PAIRS:
        return _scored_by_join(docs, counts)
    got = counts.toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))
    others = [f for f in docs.schema.fields if f.name not in ("pairs", "times")]
    n = len(others)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            pairs, times = batch.column(n), batch.column(n + 1)
            sizes = np.diff(pairs.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            often = times.flatten().to_numpy()
            sums = []
            for value in (often, np.where(best[at], often, 0) if len(pair) else often, count[at] * often if len(pair) else often):
                upto = np.concatenate([[0], np.cumsum(value)])
                ends = np.cumsum(sizes)
                sums.append(pa.array(upto[ends] - upto[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *sums], names=[*(f.name for f in others), "n_links", "n_best", "count_sum"])

    schema = StructType([*others, *(StructField(c, LongType()) for c in ("n_links", "n_best", "count_sum"))])
    return docs.select(*(f.name for f in others), "pairs", "times").mapInArrow(score, schema)


def _scored_by_join(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The same where there are too many pairs to broadcast: a document's distinct pairs meet their counts by pair, frequent ones where they stand."""
    keyed = docs.withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))
    each = keyed.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("often"))
    sized = counts.withColumn("rows", F.col("n"))
    met = join_by_key(each, sized, "pair", "rows").groupBy("at").agg(F.sum("often").alias("n_links"), F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("often")).alias("count_sum"))
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return keyed.drop("pairs", "times").join(met, "at", "left").select(*(c for c in docs.columns if c not in ("pairs", "times")), *sums)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of each document.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have zeros and an empty groups_sha256.
    Very long texts are cut where tokens of both end, which no group spans. Repeated rows come back as often, each with its
    links counted. An empty table gives no rows.
    """
    import public_tokenizers

    found = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    return scored(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps")
