"""Quality by a hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are words and runs of other marks. Features are the 1-grams and 2-grams of the tokens and the 1-grams to 3-grams of
their shapes (upper, title or lower case, digits, the marks themselves, or the same token again), hashed into 2**BITS
places; a feature's value is its share among the text's n-grams of its kind. Scores are sparse dot products. Nothing but the
text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents
from folium.llm.labelled import first_rows, remainder, sample

BITS = 18
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 1.0, 4, 8.0
THRESHOLD = 0.7
#: Tokens that a worker remembers, and an eighth of their characters; beyond that it forgets all and starts anew.
KNOWN = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    return "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "a"


class _Tokens:
    """Hashes of tokens and of their shapes, remembered by token."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.characters = 0
        self.word, self.shape = np.empty(1 << 12, "u8"), np.empty(1 << 12, "u8")

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = set(tokens).difference(self.index)
        more = sum(map(len, new))
        if len(self.index) + len(new) > KNOWN or self.characters + more > 8 * KNOWN:
            self.clear()
            new = set(tokens)
        self.characters += more
        for t in new:
            k = self.index[t] = len(self.index)
            if k == len(self.word):
                self.word, self.shape = np.concatenate([self.word, self.word]), np.concatenate([self.shape, self.shape])
            self.word[k] = crc32(t.encode("utf-8", "surrogatepass"))
            self.shape[k] = crc32(_shape(t).encode("utf-8", "surrogatepass"))
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        again = np.zeros(len(at), bool)
        again[1:] = at[1:] == at[:-1]
        return self.word[at], np.where(again, np.uint64(61), self.shape[at])


def _grams(h: np.ndarray, n: int, kind: int) -> np.ndarray:
    out = np.full(max(0, len(h) - n + 1), kind + 1, "u8")
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    found = _TOKEN.findall(text or "")
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    word, shape = tokens.of(found)
    grams = [g for g in (_grams(word, 1, 0), _grams(word, 2, 1), _grams(shape, 1, 2), _grams(shape, 2, 3), _grams(shape, 3, 4)) if len(g)]
    return np.concatenate(grams), np.concatenate([np.full(len(g), SCALE / len(g)) for g in grams])


class LogisticRegression:
    def __init__(self, bias: float, w: np.ndarray):
        self.bias, self.w = bias, w

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        logit = self.bias + float(self.w[places] @ values)
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, logit))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> LogisticRegression:
    """Row by row; the weights follow from the sums z and n of the gradients (the last place is the bias)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * 0.01))

    if len({y for *_, y in rows}) == 2:
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                at, x, y = rows[k]
                at, x = np.append(at.astype(np.int64), size), np.append(x.astype(float), 1.0)
                w = weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
    w = weights(np.arange(size + 1))
    return LogisticRegression(float(w[-1]), w[:-1].astype(np.float32))


def train(labelled: DataFrame) -> LogisticRegression:
    """labelled: the columns of labelled.sample(). Executors hash the texts; the driver gets sparse vectors of a bounded number of rows only."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            for t, y, a, b in zip(*batch.columns):
                at, x = features(t.as_py(), tokens)
                places, inverse = np.unique(at, return_inverse=True)
                values = np.bincount(inverse, x, len(places)).astype("<f4")
                yield pa.RecordBatch.from_pydict({"p": pa.array([places.astype("<u4").tobytes()], pa.binary()), "x": pa.array([values.tobytes()], pa.binary()), "y": pa.array([y.as_py()], pa.int32()), "a": pa.array([a.as_py()], pa.int64()), "b": pa.array([b.as_py()], pa.int64())})

    rows = sorted((bytes(r["p"]), bytes(r["x"]), r["y"]) for r in first_rows(labelled.select("text", "y", "a", "b").mapInArrow(hashed, "p binary, x binary, y int, a long, b long")).toLocalIterator())
    return fit([(np.frombuffer(p, "<u4"), np.frombuffer(x, "<f4"), y) for p, x, y in rows])


def score_documents(docs: DataFrame, model: LogisticRegression, name: str = "score") -> DataFrame:
    """All columns of docs, and the score; null and empty texts have the score of no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        tokens = _cached_tokens()
        return pd.Series([shared.value.score(*features(t, tokens)) for t in texts], dtype="float64")

    return docs.withColumn(name, score("text"))


_TOKENS: list[_Tokens] = []


def _cached_tokens() -> _Tokens:
    """One memory of tokens for each worker."""
    if not _TOKENS:
        _TOKENS.append(_Tokens())
    return _TOKENS[0]


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> LogisticRegression:
    return train(sample(spark, sf_dir, docs, "quality", 4, 2))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document. Without labels of both kinds every score is 0.5."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return score_documents(docs, fitted(spark, sf_dir, docs)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
