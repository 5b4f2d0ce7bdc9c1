"""Removal of long repeats by prefix-free parsing.

Whether a window of LENGTH bytes stands elsewhere is told by neighbours in the order of all suffixes. That order is made by
prefix-free parsing, place by place: rolling 8-byte hashes trigger phrases, the suffix array of the dictionary (the distinct
phrases) and that of the parse (the phrases' ranks, by prefix doubling) combine into the order of the windows, and
neighbours are compared byte by byte. So nothing goes on a hash alone.

Windows that are equal have to meet in one place. Each window has an anchor: the smallest rolling hash of those within it
(the first of equals), so equal windows have it at the same distance. The windows of one anchor stand in a row and are one
region; its key is a hash of the bytes at the anchor. Keys that occur once are left out. The bytes of the other regions meet
by key: equal regions repeat as a whole, and the different regions of a key go through the parse. Within a task equal
regions are settled before they are sent, so a passage of very many documents sends a few regions from each task.

A key with more than CROWD bytes of different regions is not gathered: its windows go into the next round, cut into regions
of fewer windows with a key over all bytes that these have in common, down to single windows, which are equal or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, erase, numbered, partitions, text_of, written

LENGTH, TRIGGER, MEAN = 400, 8, 48
#: Bytes at an anchor that make the key, and how many places of a window an anchor can have.
CORE = 32
PLACES = LENGTH - CORE + 1
#: Bytes of a text that are worked on together; their places take 22 bits.
SEGMENT = 1 << 21
#: Windows of a region at most, by round: none given in the first.
ROUNDS = (0, 16, 1)
#: Bytes of regions that are parsed together; of different regions of a key at most, else they go into the next round; and that a task remembers to settle equal ones.
CHUNK, CROWD, REMEMBERED = 1 << 20, 1 << 20, 1 << 25
#: Symbols of nine bits that a dictionary suffix is first ordered by.
FIRST = 7
#: Keys or stretches that are broadcast at most; beyond that joins shuffle.
BROADCAST_ROWS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1
_BYTES = np.array([((k + 1) * 0xBF58476D1CE4E5B9 ^ ((k + 1) * 0x94D049BB133111EB & _MASK) >> 29) & _MASK for k in range(256)], "u8")
_WEIGHTS = np.cumprod(np.full(LENGTH, _BASE, "u8"), dtype="u8")


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a view; data has eight bytes at least."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of the 8-byte strings at all places."""
    h = _words(data) * np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _stretch_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the stretches of one size that start at these places; they only tell what has to meet."""
    out = np.zeros(len(at), "u8")
    for k in range(size):
        out += _BYTES[data[at + k]] * _WEIGHTS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of each window of a stretch: the place of its smallest rolling hash, the first of equals."""
    windows = len(data) - LENGTH + 1
    h = _rolling(data)[: windows + PLACES - 1]
    h >>= np.uint64(22)
    h <<= np.uint64(22)
    h |= np.arange(len(h), dtype="u8")
    blocks = -(-len(h) // PLACES)
    padded = np.full(blocks * PLACES, _MASK, "u8")
    padded[: len(h)] = h
    padded = padded.reshape(blocks, PLACES)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[PLACES - 1 : PLACES - 1 + windows])
    return (least & np.uint64((1 << 22) - 1)).astype(np.int64)


def regions(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, first and last window, and the anchor's distance from the first, of the regions of a text; a text shorter than a window has none."""
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[s : s + SEGMENT + LENGTH - 1]
        at = anchors(part)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        yield _stretch_hashes(part, at[first], CORE).view("i8"), first + s, last + s, at[first] - first


def finer(data: np.ndarray, a: int, b: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """key, first and last window, and the anchor's distance from the first, of the regions of as many windows as width that a region falls into.

    Cells of a grid by the distance to the anchor, as equal windows have that in common. The key is over the bytes that all
    windows of a whole cell have in common, so it is the same where a region has only some of a cell's windows.
    """
    if width == 1:
        for w in range(a, b + 1):
            yield hash_of(data[w : w + LENGTH].tobytes()), w, w, 0
        return
    anchor = a + int(anchors(data[a : a + LENGTH])[0])
    cells = np.arange((anchor - b) // width, (anchor - a) // width + 1)
    keys = _stretch_hashes(data, anchor - cells * width, LENGTH - width + 1).view("i8")
    for c, key in zip(cells.tolist(), keys.tolist()):
        first = max(a, anchor - (c + 1) * width + 1)
        yield key, first, min(b, anchor - c * width), anchor - first


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and how often they occur, some hundred thousand regions at a time."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "n"])

    for batch in batches:
        for text in batch.column(0):
            for key, *_ in regions(_bytes(text.as_py())):
                held.append(key)
                n += len(key)
            if n > 200_000:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


_REGIONS = "key long, context long, row long, a int, b int, anchor int, bytes binary"
_SETTLED = b""


class _Sender:
    """Rows of regions; what equals a region that the task has sent needs no bytes, it is settled."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0
        self.seen: dict[bytes, tuple | None] = {}
        self.remembered = 0

    def add(self, key: int, row: int, a: int, b: int, anchor: int, raw: bytes) -> None:
        if raw in self.seen:
            first = self.seen[raw]
            if first is not None:
                self.rows.append((first[0] ^ first[1], 0, *first, 0, _SETTLED))
                self.seen[raw] = None
            self.rows.append((row ^ a, 0, row, a, b, 0, _SETTLED))
            self.size += 32
            return
        if self.remembered > REMEMBERED:
            self.seen, self.remembered = {}, 0
        self.seen[raw] = (row, a, b)
        self.remembered += len(raw) + 100
        self.rows.append((key, hash_of(raw), row, a, b, anchor, raw))
        self.size += len(raw) + 32

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names=[c.split()[0] for c in _REGIONS.split(", ")])
        self.rows, self.size = [], 0
        return out


def hash_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _sent(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The regions whose keys occur more than once, with their bytes. keys has key; few are broadcast, many are joined by document."""
    few = keys.count() <= BROADCAST_ROWS
    if few:
        held = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow()["key"].to_numpy()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in batches:
            wanted = held.value if few else None
            for k, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                data = _bytes(text.as_py())
                if not few:
                    wanted = np.sort(np.array(batch.column(2)[k].as_py(), np.int64))
                raw = data.tobytes()
                for key, a, b, t in regions(data):
                    known = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key if len(wanted) else np.zeros(len(key), bool)
                    for i, x, y, z in zip(*(c[known].tolist() for c in (key, a, b, t))):
                        sender.add(i, row, x, y, z, raw[x : y + LENGTH])
                        if sender.size > 1 << 22:
                            yield sender.batch()
        if sender.rows:
            yield sender.batch()

    rows = docs.select("row", "text")
    if not few:
        own = rows.mapInArrow(_keys_by_row, "row long, key long").join(keys, "key", "left_semi")
        rows = rows.join(own.groupBy("row").agg(F.collect_list("key").alias("wanted")), "row").select("row", "text", "wanted")
    return rows.mapInArrow(of, _REGIONS)


def _keys_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for key, *_ in regions(_bytes(text.as_py())):
                key = np.unique(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key)], names=["row", "key"])


def _sent_again(docs: DataFrame, stretches: DataFrame, width: int) -> DataFrame:
    """Regions of fewer windows of what a round has left open; stretches has row, a and b."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in batches:
            for row, text, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                data = _bytes(text)
                raw = data.tobytes()
                for first, last in zip(a, b):
                    for key, x, y, z in finer(data, first, last, width):
                        sender.add(key, row, x, y, z, raw[x : y + LENGTH])
                        if sender.size > 1 << 22:
                            yield sender.batch()
        if sender.rows:
            yield sender.batch()

    own = stretches.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("w")).select("row", "w.a", "w.b")
    return docs.select("row", "text").join(own, "row").select("row", "text", "a", "b").mapInArrow(of, _REGIONS)


# --- dictionary, parse and their suffix arrays -----------------------------------------------------------------------


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys (not below 0), and the ordered keys."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> (63 - bits):
        order = np.argsort(key)
        return order, key[order]
    packed = key << bits  # a sort of numbers is several times faster than one of places
    packed |= np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1), packed >> bits


def _first_places(ordered: np.ndarray) -> np.ndarray:
    """For each place of an ordered array the first place of its value."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def suffix_ranks(key: np.ndarray, left: np.ndarray, known: int) -> np.ndarray:
    """Ranks from 1 on of all suffixes, equal for equal ones, by prefix doubling.

    key is the order by their first symbols, as many as known; left: symbols from a place to the end of its string. Only
    suffixes that share a rank and go on are sorted again.
    """
    rank, n = np.zeros(len(key), np.int64), len(key) + 1
    order, ordered = _sorted(key)
    at = _first_places(ordered)
    rank[order] = at + 1
    shared = np.concatenate([at[1:] == at[:-1], [False]]) | np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool)
    active = order[shared]
    while len(active := active[left[active] >= known]):
        own = rank[active]
        after = np.where(left[active] > known, rank[np.minimum(active + known, len(key) - 1)], 0)
        order, ordered = _sorted(own * n + after)
        active, own = active[order], own[order]
        group, at = _first_places(own), _first_places(ordered)
        rank[active] = own + at - group
        same = at[1:] == at[:-1]
        active = active[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        known *= 2
    return rank


class Parse:
    """Texts in phrases: the dictionary with its suffix array, and the parse with its own."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        hashed = _rolling(data) if len(data) >= TRIGGER else np.zeros(0, "u8")
        at = np.flatnonzero((hashed >> np.uint64(32)) % np.uint64(MEAN) == 0)
        owner = np.searchsorted(ends, at, side="right")
        at = at[at + TRIGGER <= ends[owner]]
        self.at = np.unique(np.concatenate([starts, at]))
        text = np.searchsorted(ends, self.at, side="right")
        last = np.append(text[1:] != text[:-1], True)
        # A phrase ends with the trigger of the next one, or with its text.
        stop = np.where(last, ends[text], np.minimum(np.append(self.at[1:], 0) + TRIGGER, ends[text]))
        raw, index = data.tobytes(), {}
        ids = np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip(self.at.tolist(), stop.tolist())], np.int64)
        self.phrases = list(index)
        sizes = np.array(list(map(len, self.phrases)))
        self.places = np.cumsum(sizes) - sizes
        left = np.repeat(self.places + sizes, sizes) - np.arange(sizes.sum())
        symbols = np.frombuffer(b"".join(self.phrases), np.uint8).astype(np.int64) + 1
        first, padded = np.zeros(len(symbols), np.int64), np.append(symbols, np.zeros(FIRST, np.int64))
        for k in range(FIRST):
            first <<= 9
            first |= np.where(left > k, padded[k : k + len(symbols)], 0)
        self.dictionary_rank = suffix_ranks(first, left, FIRST)
        # Suffixes of the parse, by the phrases' ranks; nothing crosses the end of a text.
        whole = self.dictionary_rank[self.places][ids]
        ahead = np.searchsorted(text, text, side="right") - np.arange(len(text))
        self.parse_rank = suffix_ranks(whole, ahead, 1)
        self.ids, self.last, self.data = ids, last, data

    def order(self, at: np.ndarray) -> np.ndarray:
        """Places of the texts in the order of their suffixes: by the suffix of the phrase, then by the parse behind it."""
        phrase = np.searchsorted(self.at, at, side="right") - 1
        own = self.dictionary_rank[self.places[self.ids[phrase]] + at - self.at[phrase]]
        behind = np.where(self.last[phrase], 0, np.append(self.parse_rank[1:], 0)[phrase])
        return _sorted(own * (self.parse_rank.max(initial=0) + 1) + behind)[0]


def repeating(texts: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Of the first windows of each text, one after the other: those that equal another one, byte by byte."""
    parse = Parse(texts)
    sizes = np.array([len(t) for t in texts])
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(sizes) - sizes, windows)
    order = parse.order(at)
    # The next one in order, of each window; neighbours of windows in a row mostly stand in a row too, and are compared as one.
    other = np.full(len(at), -1)
    other[order[:-1]] = at[order[1:]]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(other) != 1)]))
    raw, words, out, unlike = parse.data.tobytes(), _words(parse.data), np.zeros(len(at), bool), []
    for k, end, x, y in zip(new.tolist(), [*new[1:].tolist(), len(at)], at[new].tolist(), other[new].tolist()):
        n = end - k + LENGTH - 1
        if y < 0:
            continue
        if n > LENGTH and raw[x : x + n] == raw[y : y + n]:
            out[k:end] = True
        elif raw[x + end - k - 1 : x + LENGTH] == raw[y + end - k - 1 : y + LENGTH] if end - k <= LENGTH else True:  # what all of them hold
            unlike.append(np.arange(k, end))
    if unlike:
        alive = np.concatenate(unlike)
        for k in range(0, LENGTH, 8):
            alive = alive[words[at[alive] + k] == words[other[alive] + k]]
        out[alive] = True
    follows = np.flatnonzero(out)  # a window that equals the next one in order makes that one repeat
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    out[order[place[follows] + 1]] = True
    return out


def _runs(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], some.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


_FOUND = "row long, a int, b int, open boolean"
#: A window has so many bytes on one side of its anchor, at least.
HALF = LENGTH // 2


def _matching(group: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """row, first and last window and bytes of what can repeat of a key's different regions: windows with HALF bytes behind the anchor that another region has there too, or with as many before it."""
    behind: dict[bytes, int] = {}
    before: dict[bytes, int] = {}
    halves = []
    for _, a, b, t, raw in group:
        x, y = raw[t : t + HALF] if b - a >= t - HALF else None, raw[t - HALF : t] if t > HALF else None
        halves.append((x, y))
        if x is not None:
            behind[x] = behind.get(x, 0) + 1
        if y is not None:
            before[y] = before.get(y, 0) + 1
    out = []
    for (row, a, b, t, raw), (x, y) in zip(group, halves):
        # Windows up to HALF before the anchor have the bytes behind it, those further before it the bytes before it.
        low = 0 if y is not None and before[y] > 1 else max(0, t - HALF)
        high = b - a if x is not None and behind[x] > 1 else min(b - a, t - HALF - 1)
        if low <= high:
            out.append((row, a + low, a + high, raw[low : high + LENGTH]))
    return out


def _found(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Of regions in order of key and context: stretches that repeat, and those of keys with more bytes of different regions than most, which stay open."""
    out: list[tuple[int, int, int, bool]] = []
    chunk: list[tuple[int, int, int, bytes]] = []  # different regions of complete keys
    group: list[tuple[int, int, int, int, bytes]] = []  # those of the present key
    held = size = 0
    key, told, crowded = None, False, False

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["row", "a", "b", "open"])
        out.clear()
        return made

    def resolve() -> None:
        nonlocal held
        if chunk:
            windows = np.array([b - a + 1 for _, a, b, _ in chunk])
            found, ends = repeating([raw for *_, raw in chunk], windows), np.cumsum(windows)
            for (row, a, _, _), n, end in zip(chunk, windows.tolist(), ends.tolist()):
                for x, y in zip(*(c.tolist() for c in _runs(found[end - n : end]))):
                    out.append((row, a + x, a + y, False))
        chunk.clear()
        held = 0

    def close() -> None:
        nonlocal held, size, crowded, told
        if crowded:
            out.extend((row, a, b, True) for row, a, b, *_ in group)
        elif len(group) > 1:
            some = _matching(group)
            if len(some) > 1:
                chunk.extend(some)
                held += sum(len(raw) for *_, raw in some)
        group.clear()
        size, crowded, told = 0, False, False

    for b in batches:
        for k, row, first, last, anchor, raw in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6))):
            if raw == _SETTLED:
                out.append((row, first, last, False))
                continue
            if k != key:
                close()
                key = k
                if held >= CHUNK:
                    resolve()
            if group and group[-1][4] == raw:
                if not told:
                    out.append((*group[-1][:3], False))
                    told = True
                out.append((row, first, last, False))
                continue
            if size > most:
                crowded = True
                out.extend((r, x, y, True) for r, x, y, *_ in group[:-1])
                del group[:-1]
                size = len(group[-1][4])
            group.append((row, first, last, anchor, raw))
            size += len(raw)
            told = False
        if len(out) > 20_000:
            yield batch()
    close()
    resolve()
    if out:
        yield batch()


def cut(text: str, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """What is left without the bytes from a to b (exclusive; in order, apart), how many bytes go, and in how many runs."""
    raw = _bytes(text).tobytes()
    edges = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [len(raw)]])
    return b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)), int((b - a).sum()), len(a)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, and starts and stops of the bytes that its windows cover, as maximal runs."""
    for batch in batches:
        rows, starts, stops = batch.column(0), [], []
        for a, b in zip(batch.column(1), batch.column(2)):
            a, b = (np.array(x.as_py()) for x in (a, b))
            order = np.argsort(a, kind="stable")
            a, ends = a[order], np.maximum.accumulate(b[order] + LENGTH)
            new = np.concatenate([[True], a[1:] > ends[:-1]])
            starts.append(a[new].astype(np.int32))
            stops.append(ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([rows, pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))], names=["row", "a", "b"])


def repeats(docs: DataFrame) -> DataFrame:
    """row, and arrays a and b: starts and ends (exclusive) of the runs of bytes that go, for each document that has some. docs has row and text."""
    parts, crowd = partitions(docs.sparkSession), CROWD
    counted = docs.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = written(counted.where("n > 1").select("key"), "keys")
    sent, found = _sent(docs, keys), []
    for k, _ in enumerate(ROUNDS):
        met = sent.repartition(parts, "key").sortWithinPartitions("key", "context")
        # Single windows of one key are equal, so nothing is left open in the last round.
        most = float("inf") if k + 1 == len(ROUNDS) else crowd
        found.append(written(met.mapInArrow(lambda batches, most=most: _found(batches, most), _FOUND), f"found-{k}"))
        left = found[-1].where("open")
        if k + 1 == len(ROUNDS) or not left.take(1):
            break
        sent = _sent_again(docs, left, ROUNDS[k + 1])
    every = found[0].where("NOT open")
    for f in found[1:]:
        every = every.unionAll(f.where("NOT open"))
    every = every.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("w")).select("row", "w.a", "w.b")
    out = written(every.mapInArrow(_merged, "row long, a array<int>, b array<int>"), "repeats")
    erase(keys, *found)
    return out


def remove(docs: DataFrame) -> DataFrame:
    """row, n_removed, n_spans, kept (binary) for each document that loses bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                kept, n, spans = cut(text, np.array(a), np.array(b))
                yield pa.RecordBatch.from_pydict({"row": pa.array([row]), "n_removed": pa.array([n]), "n_spans": pa.array([spans]), "kept": pa.array([kept], pa.binary())})

    runs = repeats(docs)
    few = (runs.agg(F.sum(F.size("a"))).first()[0] or 0) <= BROADCAST_ROWS
    texts = docs.select("row", "text").join(F.broadcast(runs) if few else runs, "row")
    return texts.select("row", "text", "a", "b").mapInArrow(of, "row long, n_removed long, n_spans long, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each document.

    Null and empty texts, and those of fewer than LENGTH bytes, lose nothing. Rows that repeat a text of LENGTH bytes or more
    lose all of it, each of them, whatever their doc_ids. An empty table gives no rows.
    """
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"), "folium_row").withColumnRenamed("folium_row", "row")
    lost = remove(docs).select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    whole = docs.select("row", "doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of().cast("binary"), 256).alias("own"))
    out = whole.join(lost, "row", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
