"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram is the elementwise product (binding)
of its letters' vectors, each rotated by its place in the n-gram; a text is the sum (bundle) of its n-grams, and a language the
bundle of its documents at unit length. A text's language is the prototype with the greatest cosine. Texts are lower-cased;
between words, and at both ends, stands one boundary, which is a letter of its own. Nothing but the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, free_name
from folium.llm.labelled import remainder

#: Dimensions of a vector, and letters of an n-gram.
DIMENSIONS, LETTERS = 1024, 3
#: Languages that a model holds, those of the most documents: 4 KB each on the driver and in each worker.
LANGUAGES = 2000
UNKNOWN = "und"
#: N-grams whose vectors are made at once, and characters of texts that are taken together.
_NGRAMS, _CHUNK = 8192, 1 << 20
_BITS = 21  # of a code point


class Letters:
    """Vectors of the letters that were met so far, as rows; the boundary is code point 0."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.rows: dict[int, np.ndarray] = {}

    def vectors(self, points: np.ndarray) -> np.ndarray:
        """A row for each of the given different code points."""
        for p in points.tolist():
            if p not in self.rows:
                self.rows[p] = np.random.Generator(np.random.Philox(key=p)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return np.stack([self.rows[p] for p in points.tolist()])

    def bound(self, ngrams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, given as code points in columns."""
        points, at = np.unique(ngrams, return_inverse=True)
        rows, at = self.vectors(points), at.reshape(ngrams.shape)
        out = np.ones((len(ngrams), self.dimensions), np.int8)
        for k in range(ngrams.shape[1]):
            out *= np.roll(rows, k, axis=1)[at[:, k]]
        return out


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; what stands between words, and before and after them, as a single 0. Empty without letters."""
    raw = (text or "").lower()
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kinds = np.unique(points)
    other = kinds[[not chr(p).isalpha() for p in kinds.tolist()]]
    if len(other) == len(kinds):
        return np.zeros(0, np.int64)
    points = np.concatenate([[0], np.where(np.isin(points, other), 0, points), [0]])
    return points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]


def ngrams_of(points: np.ndarray, n: int = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams, as one number each, and how often they stand there; n is at most 3."""
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(points) - n + 1, np.int64)
    for k in range(n):
        code = code << _BITS | points[k : len(points) - n + 1 + k]
    return np.unique(code, return_counts=True)


def bundles(texts: list[str | None], letters: Letters, n: int = LETTERS) -> np.ndarray:
    """The bundle of each text as a row; zeros for a text without letters."""
    found = [ngrams_of(letters_of(t), n) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(codes) for codes, _ in found])
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    times = np.concatenate([t for _, t in found])
    out = np.zeros((len(texts), letters.dimensions), np.float32)
    order = np.argsort(at, kind="stable")
    doc, at, times = doc[order], at[order], times[order]
    for first in range(0, len(codes), _NGRAMS):  # n-grams are bound once for all texts, so many at a time
        some = codes[first : first + _NGRAMS]
        split = np.stack([some >> _BITS * (n - 1 - k) & ((1 << _BITS) - 1) for k in range(n)], axis=1)
        a, b = np.searchsorted(at, (first, first + _NGRAMS))
        counts = np.zeros((len(texts), len(some)), np.float32)
        counts[doc[a:b], at[a:b] - first] = times[a:b]
        out += counts @ letters.bound(split).astype(np.float32)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; zeros stay."""
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches, the text in their last column, in slices of _CHUNK characters or one row."""
    for batch in batches:
        texts, first, size = [], 0, 0
        for k, t in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(t.as_py())
            size += len(texts[-1] or "") + 64
            if size >= _CHUNK or k + 1 == batch.num_rows:
                yield batch.slice(first, len(texts)), texts
                texts, first, size = [], k + 1, 0


class Languages:
    """Prototypes of the languages, in the order of their names."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        self.names, self.prototypes = names, _unit(prototypes)

    def predict(self, texts: list[str | None], letters: Letters) -> tuple[list[str], np.ndarray]:
        """Each text's language and cosine (0 if negative); of equal cosines the first name wins."""
        rows = bundles(texts, letters)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = _unit(rows) @ self.prototypes.T
        best, known = cosines.argmax(axis=1), rows.any(axis=1)
        score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], score


def train(labelled: DataFrame) -> Languages:
    """labelled: lang and text. Each partition bundles the documents of each language; the sums meet by language and dimension.

    Rows without a language are left out, as are texts without letters. All rows count.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums, n = Letters(), {}, {}
        for batch, texts in _texts(batches):
            rows, names = _unit(bundles(texts, letters)), np.array(batch.column(0).to_pylist(), object)
            full = rows.any(axis=1)
            for name in dict.fromkeys(names[full].tolist()):
                some = full & (names == name)
                sums[name] = sums.get(name, 0) + rows[some].sum(axis=0)
                n[name] = n.get(name, 0) + int(some.sum())
            if len(sums) >= LANGUAGES:
                yield _sums(sums, n)
                sums, n = {}, {}
        yield _sums(sums, n)

    def _sums(sums: dict, n: dict) -> pa.RecordBatch:
        # Whole numbers: sums of these don't depend on their order.
        whole = [np.rint(v * 2.0**24).astype(np.int64) for v in sums.values()]
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "n": pa.array([n[k] for k in sums], pa.int64()), "v": pa.array(whole, pa.list_(pa.int64()))})

    parts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(partial, "lang string, n long, v array<long>")
    added = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0).cast("long"), DIMENSIONS), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
    # A language has a row from each partition: these meet in 64 groups first, then by language.
    salted = parts.groupBy("lang", F.pmod(F.hash("v"), F.lit(64)).alias("salt")).agg(F.sum("n").alias("n"), added.alias("v"))
    whole = salted.groupBy("lang").agg(F.sum("n").alias("n"), added.alias("v"))
    rows = sorted((r["lang"], r["v"]) for r in whole.orderBy(F.desc("n"), "lang").limit(LANGUAGES).toLocalIterator())
    return Languages([lang for lang, _ in rows], np.array([v for _, v in rows], np.float64).reshape(len(rows), DIMENSIONS))


def predict(docs: DataFrame, model: Languages, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, the language of each text and its cosine; docs has no columns of these two names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def told(texts):
        import pandas as pd

        names, scores = [], []
        for _, some in _texts([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]):
            n, s = shared.value.predict(some, _LETTERS)
            names += n
            scores += s.tolist()
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype="float64")})

    both = free_name(docs, "folium_told")
    return docs.withColumn(both, told("text")).select(*docs.columns, F.col(f"{both}.lang").alias(lang), F.col(f"{both}.score").alias(score))


#: The letters that a worker has met.
_LETTERS = Letters()


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned from all documents of the other remainders that have a language.

    Null texts, and texts without a letter, are `und` with score 0; so is every text where nothing could be learned. A document
    without an id is not learned from and not held out. Repeated rows count, and come back, as often as they stand there; equal
    cosines go to the first language by name. Very long texts are one row's work. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    rest = remainder("doc_id", 4)
    model = train(docs.where(rest != 2).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
