"""Token ids by word: each distinct word is encoded once, texts are put together from the stored ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words that a worker remembers, and their characters; beyond that it forgets all and starts anew.
LIMIT, CHARACTERS = 800_000, 1 << 24


class WordCache:
    """ids of texts that are split into words. encode(words) gives the concatenated ids of the words and how many each has.

    A word's ids are stored as the bytes that a text's ids are joined from.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str, limit: int = LIMIT):
        self.encode, self.dtype, self.limit = encode, np.dtype(dtype), limit
        self.index: dict[str, bytes] = {}
        self.characters = 0

    def _stored(self, words: list[str]) -> list[bytes]:
        found = list(map(self.index.get, words))
        if None not in found:
            return found
        places = [k for k, v in enumerate(found) if v is None]
        new = list(dict.fromkeys([words[k] for k in places]))
        more = sum(map(len, new))
        if len(self.index) + len(new) > self.limit or self.characters + more > CHARACTERS:
            self.index, self.characters = {}, 0
        ids, sizes = self.encode(new)
        raw, ends = ids.astype(self.dtype).tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
        made = dict(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        if len(new) <= self.limit and more <= CHARACTERS:
            self.index.update(made)
            self.characters += more
        for k in places:
            found[k] = made[words[k]]
        return found

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated ids of all words, and the number of ids up to each word (one more than words)."""
        stored = self._stored(words)
        sizes = np.fromiter(map(len, stored), np.int64, len(stored)) // self.dtype.itemsize
        return np.frombuffer(b"".join(stored), self.dtype), np.concatenate([[0], np.cumsum(sizes)])

    def texts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, which is given as its words."""
        stored, out, at = self._stored(list(chain.from_iterable(texts))), [], 0
        for words in texts:
            out.append(np.frombuffer(b"".join(stored[at : at + len(words)]), self.dtype))
            at += len(words)
        return out


def cut_at_spaces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in UTF-8, one after the other, and the starts and ends of their words: what stands between single spaces and before line feeds. Last: the place of each text's first word, and the number of words."""
    parts = [t.replace("\n", " \n").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(parts)
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.array([len(p) + 1 for p in parts])
    return raw, starts, ends, np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts))


#: Bytes of a word that a WordTable keeps in its rows; longer words go to a WordCache.
SHORT = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")


def packed(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first SHORT bytes of words as two numbers, and their lengths; data has as many bytes more than words."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return words[starts] & _MASKS[np.minimum(n, 8)], words[starts + 8] & _MASKS[np.clip(n - 8, 0, 8)], n


class WordTable:
    """The same for many words at once, which are places in a byte string: a hash table over arrays, looked up for all words together.

    A row holds a word's bytes and length, so a hit is the word itself.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str, bits: int = 21):
        self.encode, self.dtype, self.bits = encode, np.dtype(dtype), bits
        self.long = WordCache(encode, dtype, 100_000)
        self.most = (1 << bits) * 2 // 5
        self.flat = np.empty(1 << 16, self.dtype)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.a, self.b, self.n = np.empty(self.most, "u8"), np.empty(self.most, "u8"), np.empty(self.most, np.uint8)
        self.start, self.size = np.empty(self.most, np.int32), np.empty(self.most, np.int32)
        self.rows = self.used = 0

    def _buckets(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (a ^ n.astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31)) ^ b) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rows(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The rows of words; -1 where there is none."""
        out, bucket, todo = np.full(len(a), -1, np.int64), self._buckets(a, b, n), np.arange(len(a))
        while len(todo):
            row = self.slots[bucket[todo]]
            some = row >= 0
            todo, row = todo[some], row[some]
            hit = (self.a[row] == a[todo]) & (self.b[row] == b[todo]) & (self.n[row] == n[todo])
            out[todo[hit]] = row[hit]
            todo = todo[~hit]
            bucket[todo] = (bucket[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _room(self, more: int) -> None:
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])

    def _add(self, words: list[bytes]) -> None:
        """Rows for words that have none."""
        ids, sizes = self.encode([w.decode("utf-8", "surrogatepass") for w in words])
        self._room(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        a, b, n = packed(np.frombuffer(b"".join(words) + bytes(SHORT), np.uint8), np.cumsum([0, *map(len, words[:-1])]), np.array(list(map(len, words))))
        new = np.arange(self.rows, self.rows + len(words))
        self.a[new], self.b[new], self.n[new], self.size[new] = a, b, n, sizes
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self.rows, self.used = self.rows + len(words), self.used + len(ids)
        bucket, todo = self._buckets(a, b, n), np.arange(len(words))
        while len(todo):
            free = self.slots[bucket[todo]] < 0
            _, first = np.unique(bucket[todo], return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.slots[bucket[todo[take]]] = new[todo[take]]
            todo = todo[~take]
            full = self.slots[bucket[todo]] >= 0
            bucket[todo[full]] = (bucket[todo[full]] + 1) & ((1 << self.bits) - 1)

    def ids(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated ids of the words at these places, and the number of ids up to each word (one more than words)."""
        if len(starts) > self.most:  # of a very long text: as many as fit at once
            parts = [self.ids(raw, starts[k : k + self.most], ends[k : k + self.most]) for k in range(0, len(starts), self.most)]
            sizes = np.concatenate([np.diff(upto) for _, upto in parts])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])
        data, n = np.frombuffer(raw + bytes(SHORT), np.uint8), ends - starts
        short = np.flatnonzero(n <= SHORT)
        a, b, m = packed(data, starts[short], n[short])
        row = self._rows(a, b, m)
        new = np.flatnonzero(row < 0)
        if len(new):
            words = list(dict.fromkeys([raw[x:y] for x, y in zip(starts[short[new]].tolist(), ends[short[new]].tolist())]))
            if self.rows + len(words) > self.most:
                self._clear()
                words = list(dict.fromkeys([raw[x:y] for x, y in zip(starts[short].tolist(), ends[short].tolist())]))
                new = np.arange(len(short))
            self._add(words)
            row[new] = self._rows(a[new], b[new], m[new])
        start, size = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        start[short], size[short] = self.start[row], self.size[row]
        long = np.flatnonzero(n > SHORT)
        if len(long):  # their ids stand behind the rows' for now
            got, upto = self.long.ids([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(starts[long].tolist(), ends[long].tolist())])
            self._room(len(got))
            self.flat[self.used : self.used + len(got)] = got
            start[long], size[long] = self.used + upto[:-1], np.diff(upto)
        upto = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(upto[-1])
        take += np.repeat(start - upto[:-1], size)
        return self.flat[take], upto
