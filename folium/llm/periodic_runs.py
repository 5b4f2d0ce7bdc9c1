"""Periodic runs of words: a Lyndon stack under both orders, extended by common extensions of rolling hashes.

A run is a maximal stretch of words that repeats with its smallest period. Each run holds, under one of the two orders of the
words, a Lyndon word of a period's length that is the longest one that starts where it starts. A scan from right to left
finds the longest Lyndon word of each place: it ends where the next smaller suffix starts, and those places form a stack.
Suffixes are compared, and candidates extended to both sides, by their longest common extension: a binary search over
rolling hashes whose result is held against the words themselves. No suffix array is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents

#: A run has this many words at least, and this many periods.
WORDS, PERIODS = 6, 4
#: Rolling hashes are modulo a prime; words are numbers below it.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681
#: Words that are compared one by one before hashes are.
_NEAR = 8


class Words:
    """A sequence of numbers with longest common extensions of its places."""

    def __init__(self, w: list[int]):
        self.w, self.n = w, len(w)
        self.array = np.array(w, np.int64)
        self._sums: list[int] | None = None
        self._powers: list[int] = [1]
        #: By distance, a stretch in which all words equal those at that distance, and that no word to its right continues.
        self._right: dict[int, tuple[int, int]] = {}

    def _hash(self, a: int, b: int) -> int:
        if self._sums is None:
            sums, h = [0], 0
            for x in self.w:
                h = (h * _BASE + x + 1) % _PRIME
                sums.append(h)
            self._sums = sums
        powers = self._powers
        while len(powers) <= b - a:
            powers.append(powers[-1] * _BASE % _PRIME)
        return (self._sums[b] - self._sums[a] * powers[b - a]) % _PRIME

    def _longest(self, most: int, same_hash, same_words) -> int:
        """The largest number for which the words agree, of those whose hashes agree: grows by doubling, then halves."""
        low, high = 0, 1
        while high <= most and same_hash(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            half = (low + high) // 2
            low, high = (half, high) if same_hash(half) else (low, half)
        while low and not same_words(low):  # hashes that agree by chance: the words decide
            low -= 1
        return low

    def to_right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, n = self.w, self.n
        for k in range(min(_NEAR, n - j)):
            if w[i + k] != w[j + k]:
                return k
        if n - j <= _NEAR:
            return n - j
        known = self._right.get(j - i)
        if known and known[0] <= i + _NEAR <= known[1]:
            self._right[j - i] = (min(i, known[0]), known[1])
            return known[1] - i
        at, to = i + _NEAR, j + _NEAR
        a = self.array
        found = _NEAR + self._longest(n - to, lambda k: self._hash(at, at + k) == self._hash(to, to + k), lambda k: bool((a[at : at + k] == a[to : to + k]).all()))
        self._right[j - i] = (i, i + found)
        return found

    def to_left(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        w = self.w
        for k in range(min(_NEAR, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        if i <= _NEAR:
            return i
        at, to = i - _NEAR, j - _NEAR
        a = self.array
        return _NEAR + self._longest(at, lambda k: self._hash(at - k, at) == self._hash(to - k, to), lambda k: bool((a[at - k : at] == a[to - k : to]).all()))

    def next_smaller(self, larger: bool) -> list[int]:
        """Where the next smaller suffix starts, for each place: the end of its longest Lyndon word. larger turns the order of words round.

        A suffix that starts another one is the smaller in both orders.
        """
        n = self.n
        w = [-x for x in self.w] if larger else self.w
        after, ends = self.to_right, [n] * n
        for i in range(n - 2, -1, -1):
            a, j = w[i], i + 1
            while j < n:
                b = w[j]
                if a < b:
                    j = ends[j]
                elif a > b:
                    break
                else:
                    k = after(i, j)
                    if j + k < n and w[i + k] < w[j + k]:
                        j = ends[j]
                    else:
                        break
            ends[i] = j
        return ends


def runs(words: Sequence, least_words: int = WORDS, least_periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of at least so many words and periods (two or more), by start and period."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    if len(words) < max(least_words, least_periods):
        return []
    number: dict = {}
    x = Words([number.setdefault(word, len(number)) for word in words])
    n, a = x.n, x.array
    if len(number) == n:  # no word comes twice
        return []
    found: dict[tuple[int, int], int] = {}
    for larger in (False, True):
        ends = np.array(x.next_smaller(larger), np.int64)
        first = np.arange(n)
        period = ends - first
        # The first root of a run starts within its first period: all but one of the periods follow it.
        at = first[first + (least_periods - 1) * period <= n]
        for k in range(1, least_periods - 1):
            at = at[a[at] == a[at + k * period[at]]]
            at = at[a[at + period[at] - 1] == a[at + (k + 1) * period[at] - 1]]
        order = np.lexsort((at, period[at]))
        covered = (0, 0)  # a period, and up to where its last run reaches
        for i, p in zip(at[order].tolist(), period[at[order]].tolist()):
            if covered[0] == p and i + p < covered[1]:
                continue
            right = x.to_right(i, i + p)
            left = x.to_left(i, i + p)
            if left + right >= p:
                covered = (p, i + p + right)
                length = p + left + right
                if length >= max(least_words, least_periods * p):
                    found[i - left, p] = length
    return [(s, length, p) for (s, p), length in sorted(found.items())]


def repeated(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run, after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def words_of(text: str | None) -> list[bytes]:
    """What stands between spaces, tabs, LF, VT, FF and CR, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(words: list, doc_id: int | None) -> list:
    """The words of every tenth document from a place on become periodic, by the hash of its id; a document without an id stays."""
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // len(root) + 1))[: n - a]


def find_runs(docs: DataFrame, prepared=None, least_words: int = WORDS, least_periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed (the text with each run cut to its first period), a row for each document.

    Null and blank texts have no words, no runs and are collapsed to an empty text. Words of a collapsed text stand one space
    apart. Repeated rows come back repeated; other columns are not read. prepared(words, doc_id) may change the words before. A
    document is one row and one task's work, of time in proportion to its words but for the binary searches.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_words": [], "runs": [], "collapsed": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                words = prepared(words, doc_id) if prepared else words
                found = runs(words, least_words, least_periods)
                kept = [w for w, gone in zip(words, repeated(len(words), found).tolist()) if not gone] if found else words
                for column, value in zip(out.values(), (doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(kept).decode("utf-8", "surrogatepass"))):
                    column.append(value)
                if len(out["doc_id"]) == 512:
                    yield _batch(out)
                    out = {c: [] for c in out}
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of each document.

    The run with the greatest length / period comes first, then that of the smallest start, then period; without a run these
    are null. Null, empty and blank texts have no run; so has a document of fewer than six words. Repeated rows and ids come
    back as often; a document without an id is taken as it is. An empty table gives no rows.
    """
    found = find_runs(documents(spark, sf_dir), planted)
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
    # Exact: length / period compared by cross products, as wide as two such numbers need.
    product = lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    better = lambda b, r: product(r.length, b.period) > product(b.length, r.period)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(better(b, r), r).otherwise(b))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period AS exponent_milli"), "runs_sha256", "collapsed_sha256")
