"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_j + sum over pairs <v_j, v_k>) over the distinct terms of a text: what an additive model gives,
and a learned interaction for each pair (an insult beside the mention of a group weighs more than both alone). Terms are
lower-case words and the stems (first four to eight characters) of longer ones, so that compounds of an insult count, also
as stems that two or three different words of the text share; each is hashed into 2**32 buckets. The model keeps those that
MIN_DOCS sampled documents have and whose share of toxic ones is far from the usual, alone or in a pair with another one: a
term that tells nothing by itself enters with its partner. Nothing but the text is an input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents
from folium.llm.labelled import first_rows, remainder, sample

STEMS, LEVELS = (4, 5, 6, 7, 8), 3
MIN_DOCS, FACTORS, EPOCHS, BATCH, RATE = 3, 8, 24, 64, 0.3
#: Share of a document's terms that a training step sees: what stands beside others learns to tell alone.
SEEN = 0.8
#: Standard deviations between a term's toxic documents and what the share of toxic ones lets expect, at least.
SURPRISE = 6.0
#: Terms that are looked at in pairs: so many of the most frequent ones that aren't far from the usual alone; and documents that a pair has, at least.
PAIRED, PAIR_DOCS = 2000, 8
THRESHOLD = 0.7
#: Words that a worker remembers, and an eighth of their characters; beyond that it forgets all and starts anew.
KNOWN = 200_000
_WORD = re.compile(r"\w+")


def terms(word: str) -> list[int]:
    """Buckets of the word and of its stems."""
    raw = word.encode("utf-8", "surrogatepass")
    return [crc32(raw)] + [crc32(b"\0" + word[:k].encode("utf-8", "surrogatepass")) for k in STEMS if len(word) > k]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def level(bucket: int, n: int) -> int:
    """The number of a term that at least n different words of a text have."""
    return bucket * 4 + n - 1


def text_terms(text: str | None) -> np.ndarray:
    counts = Counter(b for w in words(text) for b in terms(w))
    return np.unique(np.array([level(b, n) for b, c in counts.items() for n in range(1, min(c, LEVELS) + 1)], "<i8"))


class FactorizationMachine:
    """bias, and weights w and factors v of the kept buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.place = {int(b): k for k, b in enumerate(buckets)}
        self.bias, self.w, self.v = bias, w, v
        self.bases = {x // 4 for x in self.place}
        self.known: set[str] = set()
        self.characters = 0
        self.hot: dict[str, list[int]] = {}

    def _meet(self, new: set[str]) -> None:
        """Remember words, and for those of which the model has a bucket which."""
        more = sum(map(len, new))
        if len(self.known) + len(new) > KNOWN or self.characters + more > 8 * KNOWN:
            self.known.clear()
            self.hot.clear()
            self.characters = 0
        self.characters += more
        self.known |= new
        for word in new:
            if got := [b for b in terms(word) if b in self.bases]:
                self.hot[word] = got

    def score(self, text: str | None) -> float:
        found = words(text)
        self._meet(found.difference(self.known))
        if not self.known.issuperset(found):  # all was forgotten
            self._meet(found)
        counts = Counter(b for w in found.intersection(self.hot) for b in self.hot[w])
        at = sorted({self.place[x] for b, c in counts.items() for x in (level(b, n) for n in range(1, min(c, LEVELS) + 1)) if x in self.place})
        v = self.v[at]
        logit = self.bias + float(self.w[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, logit))))


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> FactorizationMachine:
    """By AdaGrad in small batches."""
    y = np.array([t for _, t in rows], float)
    every = np.concatenate([b for b, _ in rows]) if rows else np.zeros(0, np.int64)
    buckets, place, n = np.unique(every, return_inverse=True, return_counts=True)
    toxic, share = np.bincount(place, np.repeat(y, [len(b) for b, _ in rows]), len(n)), y.mean() if len(y) else 0.0
    surprise = np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    buckets = buckets[(n >= MIN_DOCS) & ((surprise >= SURPRISE) | _in_pairs(rows, y, place, n, surprise))]
    if not len(buckets) or y.min() == y.max():
        return FactorizationMachine(buckets[:0], 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    docs = []
    for b, _ in rows:
        at = np.minimum(np.searchsorted(buckets, b), len(buckets) - 1)
        docs.append(at[buckets[at] == b])
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets)), rng.normal(0, 0.02, (len(buckets), FACTORS))
    gw, gv, bias, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 0.0, 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at, row = np.concatenate([docs[i] for i in some]), np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
            seen = rng.random(len(at)) < SEEN
            at, row = at[seen], row[seen]
            sums = np.zeros((len(some), FACTORS))
            np.add.at(sums, row, v[at])
            squares = np.bincount(row, (v[at] ** 2).sum(axis=1), len(some))
            logit = bias + np.bincount(row, w[at], len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, error[row], len(used))
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, place, error[row, None] * (sums[row] - v[at]))
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            for p, g, d in ((w, gw, dw), (v, gv, dv)):
                p[used] -= RATE / np.sqrt(g[used]) * d
            bias -= RATE / np.sqrt(gb) * error.sum()
    return FactorizationMachine(buckets, bias, w, v)


def _in_pairs(rows: list[tuple[np.ndarray, int]], y: np.ndarray, place: np.ndarray, n: np.ndarray, surprise: np.ndarray) -> np.ndarray:
    """Which terms are far from the usual in a pair: by the toxic documents of all pairs of frequent terms that tell nothing alone."""
    out = np.zeros(len(n), bool)
    quiet = np.flatnonzero((n >= max(MIN_DOCS, PAIR_DOCS)) & (surprise < SURPRISE) & (n < 0.9 * len(rows)))
    some = np.sort(quiet[np.argsort(-n[quiet], kind="stable")[:PAIRED]])
    if len(some) < 2 or y.min() == y.max():
        return out
    column = np.full(len(n), -1)
    column[some] = np.arange(len(some))
    row, at = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows]), column[place]
    has = np.zeros((len(rows), len(some)), np.float32)
    has[row[at >= 0], at[at >= 0]] = 1
    both, toxic, share = has.T @ has, has[y == 1].T @ has[y == 1], y.mean()
    far = np.abs(toxic - both * share) / np.sqrt(both * share * (1 - share) + 1e-9)
    far[both < PAIR_DOCS] = 0
    np.fill_diagonal(far, 0)
    out[some[far.max(axis=1) >= SURPRISE]] = True
    return out


def train(labelled: DataFrame) -> FactorizationMachine:
    """labelled: the columns of labelled.sample(). Executors hash the texts; the driver gets the buckets of a bounded number of rows only."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_terms(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), *batch.columns[1:]], names=["terms", "y", "a", "b"])

    rows = first_rows(labelled.select("text", "y", "a", "b").mapInArrow(hashed, "terms binary, y int, a long, b long")).collect()
    rows = sorted((bytes(r["terms"]), r["y"]) for r in rows)
    return fit([(np.frombuffer(b, "<i8"), y) for b, y in rows])


def score_documents(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and score; null and empty texts have the score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document. Without labels of both kinds every score is 0.5.

    Null and empty texts have the score of no terms. Repeated rows come back as often, and equal texts have equal scores; very
    long texts are taken whole. Null labels teach nothing. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    model = train(sample(spark, sf_dir, docs, "toxic", 3, 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
