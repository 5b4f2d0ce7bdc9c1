"""N-gram Jaccard join by count-vector R-trees.

A document is the set of its word n-grams, as 64-bit hashes; equal sets are one node from the start. The hashes fall into
groups, and the counts by group are a point: two sets share at most the sum of the coordinates' minima. Nodes that can link
share one of the first hashes of their sets (as many as a set may lack, and one) in any order that is the same for all, so
nodes meet by those hashes. The order is by hash, with those last that are frequent in a sample of SAMPLE documents: then
common lines are no meeting places. The sample decides nothing but the order; every order gives the same groups. Where
nodes meet, an R-tree over their points (tiles by size, then by a coordinate) is joined with itself: boxes whose bound is
too low are left out, then points. Nodes of surviving pairs are one cluster, whatever lies between them, so no link leaves
its cluster. A cluster's whole sets are brought together once, joined by an R-tree over points of more groups, and the
pairs that survive are intersected.

Only connected groups are asked for. So a place of either kind gives a spanning forest and no more: pairs of nodes that
are connected by then are left out, and what comes out is never more than what goes in. The smallest hashes go first, each
block of nodes against one or two pivots, which brings nearly all copies of one text together before the complete step.
Places of more than BLOCK nodes are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, erase, free_name, numbered, partitions, written
from folium.llm.components import components
from folium.llm.word_cache import SHORT, packed

GROUPS = 64
#: Points of larger sets have more groups, so that a group's share stays small: sizes up to which 64 and 256 do; beyond, 1024.
STEPS = (256, 1024)
#: A coordinate of so much bounds nothing.
FULL = 255
LEAF, FAN, BLOCK = 32, 16, 4096
#: So many of a node's smallest hashes go first, and the bytes of sets in half a place of a cluster.
FIRST, BYTES = 3, 16 << 20
#: Documents of the sample, about; in so many of them a hash is frequent, and so many of the most frequent ones go last.
SAMPLE, FREQUENT, LAST = 8000, 3, 100_000
#: Rows of one hash that are compared by size and place, at most; more are left to the R-trees.
LAG = 32
#: Nodes whose texts are fetched by a broadcast of their rows at most; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)], np.int8)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, and the place of each text's first word, and the number of words.

    Words of up to SHORT bytes are mixed together, the others one by one; nothing is remembered.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    raw = b" ".join([*parts, b""])
    data = np.frombuffer(raw + bytes(SHORT), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data[: len(raw)]], prepend=np.int8(1)))  # from white space to words and back
    starts, n = edges[::2], edges[1::2] - edges[::2]
    a, b, _ = packed(data, starts, n)
    h = (a ^ n.astype("u8") * _ODD[0]) * _ODD[1]
    h = (h ^ (h >> np.uint64(31)) ^ b) * _ODD[2]
    h = (h ^ (h >> np.uint64(29))) * _ODD[3]
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(n > SHORT).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + n[k]])
    sizes = np.array([len(p) + 1 for p in parts])
    return h, np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a text's words; of fewer words the whole sequence; none without words."""
    if not len(h):
        return h
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, "u8")
    for j in range(size):
        out += h[j : j + len(out)] * _ODD[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    h, first = word_hashes(texts.to_pylist())
    return [shingles(h[a:b], k) for a, b in zip(first.tolist(), first[1:].tolist())]


def _prefix(n: int, percent: int) -> int:
    """So many of the smallest hashes of a set of n: sets that link share one of theirs."""
    return n - (n * percent + 99) // 100 + 1


def _first(s: np.ndarray, size: int, last: np.ndarray) -> np.ndarray:
    """The first hashes of a set, as many as size: those that aren't in last by size, then the others; both are sorted."""
    step = 2 * size + 16
    while len(last):
        some = s[:step]
        late = last[np.minimum(np.searchsorted(last, some), len(last) - 1)] == some
        early = some[~late]
        if len(early) >= size:
            return early[:size]
        if step >= len(s):
            return np.concatenate([early, some[late]])[:size]
        step *= 2
    return s[:size]


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes that go last; LAST of them at most, 8 bytes each. The sample is the documents whose row numbers have small hashes."""
    share = SAMPLE / max(1, docs.count())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for s in sets_of(batch.column(0).slice(at, 200), k):
                    yield pa.RecordBatch.from_pydict({"h": pa.array(s.view("i8"), pa.int64())})

    few = docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))
    counted = few.select("text").mapInArrow(of, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.h for r in counted.orderBy(F.col("n").desc(), "h").limit(LAST).collect()], "i8").view("u8"))


def _level(n: int) -> int:
    return sum(n > step for step in STEPS)


def _point(s: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group."""
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def _folded(points: np.ndarray, groups: int) -> np.ndarray:
    """The same points with fewer groups: each is a sum of theirs."""
    sums = points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int64)
    sums[(points == FULL).any(axis=1)] = FULL
    return np.minimum(sums, FULL).astype(np.uint8)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Elements that sets of these sizes share at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def _bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of the coordinates' minima, of each of p with each of q. A full coordinate bounds nothing."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, 4_000_000 // max(1, q.size))
    for k in range(0, len(p), step):
        out[k : k + step] = np.minimum(p[k : k + step, None, :], q[None, :, :]).sum(axis=2, dtype=np.int64)
    full_p, full_q = (p == FULL).any(axis=1), (q == FULL).any(axis=1)
    if full_p.any() or full_q.any():
        out[full_p[:, None] | full_q[None, :]] = np.iinfo(np.int64).max
    return out


class RTree:
    """Points of sets (rows of points, which idx names), packed by size, then within a slab of leaves by the first coordinate."""

    def __init__(self, idx: np.ndarray, n: np.ndarray, points: np.ndarray):
        order = np.argsort(n, kind="stable")
        for k in range(0, len(n), LEAF * FAN):
            slab = order[k : k + LEAF * FAN]
            order[k : k + LEAF * FAN] = slab[np.argsort(points[slab, 0], kind="stable")]
        self.order, self.n, self.points = idx[order], n[order], points[order]
        starts = np.arange(0, len(n), LEAF)
        self.least, self.most = np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts)
        self.box = np.maximum.reduceat(self.points, starts, axis=0)

    def join(self, other: RTree, percent: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Names of pairs whose bound reaches what a link needs, leaf by leaf; of self with itself each pair once.

        Leaves whose nodes all have one label by then are left out, and so are such pairs.
        """
        size = (self.most[:, None] * 100 >= other.least[None, :] * percent) & (other.most[None, :] * 100 >= self.least[:, None] * percent)
        if self is other:
            size &= np.arange(len(self.least))[:, None] <= np.arange(len(self.least))[None, :]
        for i in range(len(self.least)):
            near = np.flatnonzero(size[i])
            if not len(near):
                continue
            low = _needed(self.least[i], other.least[near], percent)
            near = near[_bound(self.box[i : i + 1], other.box[near])[0] >= low]
            a = slice(i * LEAF, (i + 1) * LEAF)
            for j in near:
                b = slice(j * LEAF, (j + 1) * LEAF)
                apart = label[self.order[a]][:, None] != label[other.order[b]][None, :]
                if not apart.any():
                    continue
                ok = apart & (_bound(self.points[a], other.points[b]) >= _needed(self.n[a][:, None], other.n[b][None, :], percent))
                ok &= np.minimum(self.n[a][:, None], other.n[b][None, :]) * 100 >= np.maximum(self.n[a][:, None], other.n[b][None, :]) * percent
                if self is other and i == j:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    yield self.order[a][x], other.order[b][y]


class Forest:
    """Labels of nodes that grow together, and the pairs that joined them."""

    def __init__(self, label: np.ndarray):
        self.label, self.pairs = label, []

    def join(self, x: int, y: int) -> None:
        a, b = self.label[x], self.label[y]
        if a != b:
            self.label[self.label == b] = a
            self.pairs.append((x, y))


def _trees(n: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> list[list[tuple[RTree, RTree | None]]]:
    """By level of size: the trees of each label of many nodes and of the others; each with one over the next smaller level's groups."""
    out = []
    for k, (idx, points) in enumerate(levels):
        trees = []
        if len(idx):
            _, inverse, count = np.unique(label[idx], return_inverse=True, return_counts=True)
            kind = np.where(count[inverse] > 4 * LEAF, inverse + 1, 0)
            for c in np.unique(kind):
                at = np.flatnonzero(kind == c)
                folded = _folded(points[at], points.shape[1] // 4) if k and len(levels[k - 1][0]) else None
                trees.append((RTree(idx[at], n[idx[at]], points[at]), RTree(idx[at], n[idx[at]], folded) if folded is not None else None))
        out.append(trees)
    return out


def _surviving(n: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different labels that the R-trees leave. Levels apart by two can't be of similar size; of neighbours the larger is folded."""
    trees = _trees(n, levels, label)
    for k, level in enumerate(trees):
        for i, (tree, folded) in enumerate(level):
            for other, _ in level[: i + 1]:
                if other is not tree or (label[tree.order] != label[tree.order[0]]).any():
                    yield from tree.join(other, percent, label)
            for other, _ in trees[k - 1] if k else ():
                yield from folded.join(other, percent, label)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows with the same first columns, as many as keys, out of batches that are sorted by them."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: _column(batch.column(i), batch.num_rows) for i, n in enumerate(batch.schema.names)}
        names = batch.schema.names[:keys]
        new = np.zeros(batch.num_rows, bool)
        for c in names:
            new[1:] |= rows[c][1:] != rows[c][:-1]
        new[0] = bool(held) and any(rows[c][0] != held[-1][c][-1] for c in names)
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if (a or new[0]) and held:
                yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held = []
            if b > a:
                held.append({k: v[a:b] for k, v in rows.items()})
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def _meetings(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Blocks of rows with the same h out of batches that are sorted by h; True: the first block of an h."""
    held: dict[str, np.ndarray] = {}
    last = None

    def cut(rows: dict[str, np.ndarray], end: bool):
        nonlocal last, held
        starts = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
        ends = np.append(starts[1:], len(rows["h"]))
        held = {}
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b == len(rows["h"]) and not end and b - a < block:
                held = {k: v[a:b] for k, v in rows.items()}
                break
            for c in range(a, b, block):
                d = min(b, c + block)
                if d == len(rows["h"]) and not end and d - c < block:
                    held = {k: v[c:d] for k, v in rows.items()}
                    break
                part = {k: v[c:d] for k, v in rows.items()}
                yield part["h"][0] != last, part
                last = part["h"][0]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: _column(batch.column(i), batch.num_rows) for i, n in enumerate(batch.schema.names)}
        if held:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        yield from cut(rows, False)
    if held:
        yield from cut(held, True)


def _column(c: pa.Array, rows: int) -> np.ndarray:
    if pa.types.is_integer(c.type):
        return c.to_numpy(zero_copy_only=False)
    return np.array([*c.to_pylist(), None], object)[:-1]


def _matrix(points: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_pydict({"u": pa.array(pairs[0], pa.int64()), "v": pa.array(pairs[1], pa.int64())})


def _buffered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Distinct pairs, some hundred thousand at a time: the same pair comes from many places."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    n = 0
    for x, y in pairs:
        a.append(x)
        b.append(y)
        n += len(x)
        if n >= rows:
            yield _pair_batch(np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0
    if n:
        yield _pair_batch(np.concatenate(a), np.concatenate(b))


def _to_pivots(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each node with the node in the middle of its block, or if their bound is too low with the smallest of the others."""
    for _, rows in _meetings(batches, BLOCK):
        left = np.arange(len(rows["n"]))
        for middle in (True, False):
            n, node = rows["n"][left].astype(np.int64), rows["node"][left]
            levels = np.array([len(p) for p in rows["point"][left]])
            at = left[np.flatnonzero(levels == np.bincount(levels).argmax())] if len(left) else left
            if not len(at):
                break
            points = _matrix(rows["point"][at])
            if middle:
                p = at[int((np.minimum(points, np.median(points, axis=0)).sum(axis=1) / np.maximum(1, rows["n"][at])).argmax())]
            else:
                p = left[int(node.argmin())]
            ok = np.zeros(len(left), bool)
            for groups in np.unique(levels):
                some = np.flatnonzero(levels == groups)
                low = min(int(groups), len(rows["point"][p]))
                ok[some] = _bound(_folded(_matrix(rows["point"][[p]]), low), _folded(_matrix(rows["point"][left[some]]), low))[0] >= _needed(rows["n"][p], n[some], percent)
            ok &= np.minimum(rows["n"][p], n) * 100 >= np.maximum(rows["n"][p], n) * percent
            ok |= left == p
            others = left[ok & (left != p)]
            if len(others):
                yield np.full(len(others), rows["node"][p]), rows["node"][others]
            left = left[~ok]


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest, in roots, of what the R-trees leave of each place."""
    for rows in _groups(batches, 3):
        roots, label = np.unique(rows["root"], return_inverse=True)
        if len(roots) == 1:
            continue
        size = np.array([len(p) for p in rows["point"]])
        levels = [(at, _matrix(rows["point"][at]) if len(at) else None) for g in range(len(STEPS) + 1) for at in [np.flatnonzero(size == GROUPS << 2 * g)]]
        forest = Forest(label)
        for x, y in _surviving(rows["n"].astype(np.int64), levels, label, percent):
            for k in np.unique(label[x] * len(roots) + label[y], return_index=True)[1]:
                forest.join(x[k], y[k])
        if forest.pairs:
            x, y = np.array(forest.pairs).T
            yield rows["root"][x], rows["root"][y]


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """node, root and whole: each set that links with others of the place, with the smallest node that its links reach there, and whether the place holds the whole cluster."""
    for rows in _groups(batches, 3):
        sets = [np.frombuffer(s, "u8") for s in rows["s"]]
        n, node = np.array(list(map(len, sets))), rows["node"]
        groups = GROUPS << 2 * min(len(STEPS), _level(int(n.max())) + 1)
        points = np.stack([_point(s, groups) for s in sets])
        forest = Forest(np.arange(len(sets)))

        def common(x: int, others: np.ndarray) -> np.ndarray:
            """Which of the others link with x."""
            flat, s = np.concatenate([sets[y] for y in others]), sets[x]
            hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(n[others]) - n[others], dtype=np.int64)
            return 100 * both >= percent * (n[x] + n[others] - both)

        middle = np.minimum(points, np.median(points, axis=0)).sum(axis=1) / n
        for p in (int(middle.argmax()), int(node.argmin())):
            near = (_bound(points[p : p + 1], points)[0] >= _needed(n[p], n, percent)) & (forest.label != forest.label[p])
            near = np.flatnonzero(near & (np.minimum(n[p], n) * 100 >= np.maximum(n[p], n) * percent))
            for k in range(0, len(near), 256):
                part = near[k : k + 256]
                for y in part[common(p, part)]:
                    forest.join(p, y)
        for x, y in _surviving(n, [(np.arange(len(sets)), points)], forest.label, percent):
            for a in np.unique(x):
                others = y[x == a]
                others = others[forest.label[others] != forest.label[a]]
                if len(others):
                    for b in others[common(a, others)]:
                        forest.join(a, b)
        if forest.pairs:
            order = np.argsort(node)
            labels, first, inverse = np.unique(forest.label[order], return_index=True, return_inverse=True)
            root = np.empty(len(node), np.int64)
            root[order] = node[order][first][inverse]
            some = root != node
            whole = np.full(int(some.sum()), rows["i"][0] == rows["j"][0])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some]), pa.array(whole)], names=["node", "root", "whole"])


def _mapped(df: DataFrame, f: Callable, percent: int) -> DataFrame:
    return df.mapInArrow(lambda batches: _buffered(f(batches, percent)), "u long, v long").distinct()


def _dealt(df: DataFrame, key: str, blocks: str, node: str, parts: int, cols: list[str]) -> DataFrame:
    """Places of blocks = 1 as they are; of more, each pair of blocks of nodes is a place: key, i, j and cols, sorted by place."""
    own = F.pmod(F.xxhash64(node), F.col(blocks))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), lambda k: (k != own) | (F.col(blocks) == 1))
    df = df.withColumn("other", F.explode(others)).withColumn("i", F.least(own, F.col("other"))).withColumn("j", F.greatest(own, F.col("other")))
    return df.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j").select(key, "i", "j", *cols)


def _shingled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row, doc_id, node (hash of the set; null without words), n, prefix and point (of its level) of each document; docs has row, doc_id and text."""

    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = sets_of(part.column(2), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(0),
                        "doc_id": part.column(1).cast(pa.int64()),
                        "node": pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        "n": pa.array(list(map(len, sets)), pa.int64()),
                        "prefix": pa.array([_first(s, _prefix(len(s), percent), last.value).view("i8") if len(s) else s.view("i8") for s in sets], pa.list_(pa.int64())),
                        "point": pa.array([_point(s, GROUPS << 2 * _level(len(s))).tobytes() for s in sets], pa.binary()),
                    }
                )

    return docs.select("row", "doc_id", "text").mapInArrow(of, "row long, doc_id long, node long, n long, prefix array<long>, point binary")


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _sets(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """cluster, blocks, node and s (its set) of the nodes, from the text of one of their documents."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    few = few.select("cluster", "blocks", "node", F.col("row").alias("r"), F.col("doc_id").alias("d"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in sets_of(part.column(3), k)], pa.binary())], names=["cluster", "blocks", "node", "s"])

    texts = docs.join(few, (docs["row"] == F.col("r")) & docs["doc_id"].eqNullSafe(F.col("d"))).select("cluster", "blocks", "node", "text")
    return texts.mapInArrow(of, "cluster long, blocks long, node long, s binary")


def group(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and root of each document; docs has row, doc_id and text.

    component_id is the smallest doc_id that links reach; a document without words is its own. Rows with the same set are
    one node, whatever their ids. A null doc_id counts last, and is the component_id only where there is no other. As ids
    may be null or repeat, only root (the smallest node; null without words) tells components apart.
    """
    parts = partitions(docs.sparkSession)
    every = written(_shingled(docs, k, percent), "shingled")
    reps = written(every.where("node IS NOT NULL").dropDuplicates(["node"]), "nodes")
    postings = reps.select(F.posexplode("prefix").alias("at", "h"), "node", F.col("n").cast("int").alias("n")).select("h", "node", "n", "at").repartition(parts, "h").sortWithinPartitions("h")
    met = written(postings.mapInArrow(lambda batches: _shared(batches, percent), "h long, node long, n int, at int").drop("n"), "met")
    points = reps.select("node", "n", "point")
    first = met.where(F.col("at") < FIRST).join(points, "node").repartition(parts, "h").sortWithinPartitions("h", "n").select("h", "node", "n", "point")
    roots = components(_mapped(first, _to_pivots, percent))
    # Places of one root are done.
    named = met.join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    open_ = named.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    open_ = open_.select("h", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    rest = _dealt(named.join(open_, "h").join(points, "node"), "h", "blocks", "node", parts, ["node", "n", "point", "root"])
    more = written(_mapped(rest, _near, percent), "near")
    wider = components(more)
    # Nodes of clusters of two or more.
    ends = more.select("u").unionAll(more.select("v")).toDF("node")
    members = roots.select("node", "root").unionAll(roots.select("root", "root")).unionAll(ends.select("node", "node")).distinct().toDF("node", "root")
    members = members.join(wider.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root", "left").select("node", F.coalesce("cluster", "root").alias("cluster"))
    members = members.join(reps.select("node", "n", "row", "doc_id"), "node")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)), F.ceil(F.sum("n") * 8 / BYTES)).alias("blocks"))
    wanted = written(members.join(blocks, "cluster"), "wanted")
    erase(met, more, reps)
    sets = _dealt(_sets(wanted, docs, k), "cluster", "blocks", "node", parts, ["node", "s"])
    linked = written(sets.mapInArrow(lambda batches: _linked(batches, percent), "node long, root long, whole boolean"), "linked")
    roots = linked.where("whole").select("node", "root")
    parted = linked.where("NOT whole").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if parted.take(1):  # clusters that lie in several places
        roots = roots.unionAll(components(parted))
    classes = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("node", "root").join(whole, "root").select("node", "component_id", "root")
    out = every.select("row", "doc_id", "node", F.col("n").alias("n_shingles"))
    linked = out.where("node IS NOT NULL").join(named, "node").select("row", "doc_id", "n_shingles", "component_id", "root")
    return linked.unionAll(out.where("node IS NULL").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("node").alias("root")))


def _possible(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Rows that may link with another one of the same h; rows has all of each h. Of an h with more than LAG rows all stay."""
    h, n, at = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3))
    _, group, count = np.unique(h, return_inverse=True, return_counts=True)
    keep, few = count[group] > LAG, count[group] <= LAG
    for d in range(1, min(LAG, int(count.max(initial=0)))):
        x = np.flatnonzero((group[d:] == group[:-d]) & few[d:])
        y = x + d
        # Two sets share no more hashes than stand before and behind h in both, whatever the order is.
        shared = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1
        ok = (shared >= _needed(n[x], n[y], percent)) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        keep[x[ok]] = keep[y[ok]] = True
    return rows.filter(pa.array(keep))


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows that may link with another one of the same h; batches are sorted by h. Few rows are held, however many share an h."""
    held, long = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy(zero_copy_only=False)
        start, end = int(np.searchsorted(h, long, "right")) if long is not None else 0, int(np.searchsorted(h, h[-1]))
        if start:
            yield batch.slice(0, start)
        if end > start:
            yield _possible(batch.slice(start, end - start), percent)
        held = batch.slice(max(start, end))
        if held.num_rows > LAG:
            yield held
            held, long = None, h[-1]
        elif not held.num_rows:
            held = None
    if held is not None:
        yield _possible(held, percent)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id for each document: 4-word shingles, Jaccard similarity of 0.85 or more.

    Null, empty and blank texts have no shingles and are their own component. Rows that repeat a text are one component, and
    so are rows of one doc_id only if their texts link. A null doc_id counts last. An empty table gives no rows.
    """
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"), "folium_row").withColumnRenamed("folium_row", "row")
    return group(docs, 4, 85).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one of the smallest doc_id (of rows that repeat it, the first by row); documents without words stay."""
    row = free_name(docs, "folium_row")
    every = numbered(docs, row)
    thin = every.select("doc_id", "text", F.col(row).alias("row"))
    found = written(group(thin, k, percent), "grouped")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("w")).select("w.row", "w.doc_id")
    stay = first.unionAll(found.where("n_shingles = 0").select("row", "doc_id")).select(F.col("row").alias("r"), F.col("doc_id").alias("d"))
    return every.join(stay, (every[row] == F.col("r")) & every["doc_id"].eqNullSafe(F.col("d")), "left_semi").drop(row)
