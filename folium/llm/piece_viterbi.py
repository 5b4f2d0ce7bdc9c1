"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A model of this kind merges the best-ranked adjacent pair again and again. The same segmentation is the only path through
the lattice of pieces on which every two neighbours are a pair that merging would leave alone, and that path is found from
left to right: the last piece of each prefix depends on shorter prefixes only. So all distinct words of one length advance
together, a column at a time: the hashes of the substrings that end there are looked up among the sorted hashes of the
pieces, candidates whose left neighbour wouldn't have been left alone score minus infinity, and the maxima are stored as
backpointers. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folium.llm.common import documents
from folium.llm.word_cache import WordCache, WordTable, cut_at_spaces

MARK = "▁"
#: Longer words are cut where no piece spans; what stays longer is merged on its own.
LONGEST = 192
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


def merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The plain algorithm on one word: the symbols that are left, and the last pair that was merged."""
    left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    parts: list[str | None] = list(symbols)
    heap = [(rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
    heapq.heapify(heap)
    last = None
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j], last = a + b, None, (a, b)
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] >= 0 and parts[k] + parts[right[k]] in rank:
                heapq.heappush(heap, (rank[parts[k] + parts[right[k]]], k, parts[k], parts[right[k]]))
    return [p for p in parts if p is not None], last


class PieceModel:
    """What the search needs of a model with byte pieces, a dummy prefix and no other normalisation. Built once; workers get a copy."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.text = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        self.runs = {p: i for p, i in every.items() if len(p) > 1 and not p.strip(MARK)}
        if any(len(p) > 1 and MARK in p[1:] for p in every if p not in self.runs):
            raise ValueError("pieces that hold a space inside aren't supported")
        self.run_rank = {p: (-sp.get_score(i)) for p, i in self.runs.items()}
        self.vocab = {p: i for p, i in every.items() if p not in self.runs}
        # Ranks: characters first, then the pieces in the order in which pairs are merged.
        order = sorted(self.vocab, key=lambda p: (len(p) > 1, -sp.get_score(self.vocab[p]) if len(p) > 1 else 0))
        rank = {p: r for r, p in enumerate(order)}
        merges = {p: r for p, r in rank.items() if len(p) > 1}
        halves = np.repeat(np.arange(len(order)), 2).reshape(-1, 2)
        reached = np.ones(len(order), bool)
        for p, r in merges.items():
            parts, last = merge(list(p), merges)
            reached[r] = len(parts) == 1
            if reached[r]:
                halves[r] = rank[last[0]], rank[last[1]]
        self.rank, self.merges, self.size, self.halves = rank, merges, len(order), halves
        self.piece_id = np.array([self.vocab[p] for p in order])
        pairs = sorted((rank[p[:k]] * len(order) + rank[p[k:]], r) for p, r in merges.items() for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank)
        self.pair_keys, self.pair_ranks = (np.array(x) for x in zip(*pairs))
        keys = sorted((int(self._hash(np.array([[ord(c) for c in p]], "u4"))[0, -1]), len(p), r) for p, r in rank.items() if reached[r])
        self.keys, self.key_size, self.key_rank = (np.array(x, d) for x, d in zip(zip(*keys), ("u8", "i4", "i8")))
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have the same hash")
        self.bits = np.zeros(1 << 20, bool)  # which leading 20 bits some key has: most substrings end here
        self.bits[self.keys >> np.uint64(44)] = True
        self.longest = max(map(len, rank))
        self.spanned = {p[k : k + 2] for p in merges for k in range(len(p) - 1)}
        self.alphabet = {p for p in rank if len(p) == 1}
        # Marks that no piece has right behind a letter: a word can be cut before them.
        marks = {c for c in self.alphabet if c < "\x7f" and not c.isalnum()} - {b for a, b in self.spanned if a.isalpha()}
        self.before_mark = re.compile("(?<=[^\\W\\d_])(?=[" + re.escape("".join(sorted(marks))) + "\n])|(?<=\n)")

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Prefix hashes, by row; the hash of a whole row is the last one."""
        out = np.zeros((len(codes), codes.shape[1] + 1), "u8")
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + (codes[:, j].astype("u8") + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return out

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Would merging leave a | b apart? Undo the merges of both sides, the latest first, and look for one across the gap that came before."""
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        limit, live = np.full(len(a), _NONE), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            early = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            ok[live[early]] = False
            live, x, y = live[~early], x[~early], y[~early]
            bound = np.empty(len(live), np.int64)
            end = np.zeros(len(live), bool)
            for first in (True, False):  # the later of the two merges is undone; where that side is a character, the other
                of_a = np.flatnonzero((x > y) if first else (x <= y))
                p, q = x[of_a], y[of_a]
                if first:
                    bound[of_a] = p
                    nx = self.halves[p, 1]
                    whole = nx == p
                    x[of_a] = nx
                    k, q = of_a[whole], q[whole]
                    bound[k] = q + 1
                    ny = self.halves[q, 0]
                    end[k] = ny == q
                    y[k] = ny
                    done = of_a
                else:
                    of_b = np.setdiff1d(of_a, done, assume_unique=True) if len(done) else of_a
                    p, q = x[of_b], y[of_b]
                    bound[of_b] = q + 1
                    ny = self.halves[q, 0]
                    whole = ny == q
                    y[of_b] = ny
                    k, p = of_b[whole], p[whole]
                    bound[k] = p
                    nx = self.halves[p, 1]
                    end[k] = nx == p
                    x[k] = nx
            a[live], b[live], limit[live] = x, y, bound
            live = live[~end]
        return ok

    def _search(self, words: list[str]) -> list[np.ndarray]:
        """Ranks of the pieces of words of one length; -1 - code point for a character without a piece."""
        size, n = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size)
        hashes = self._hash(codes)
        power = np.array([pow(int(_BASE), k, 2**64) for k in range(self.longest + 1)], "u8")
        last = np.full((n, size + 1), -1, np.int64)
        back = np.ones((n, size + 1), np.int64)
        for j in range(1, size + 1):
            width = min(j, self.longest)
            begins = np.arange(j - width, j)
            key = hashes[:, j : j + 1] - hashes[:, begins] * power[j - begins]
            row, col = np.nonzero(self.bits[key >> np.uint64(44)])
            key = key[row, col]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.key_size[at] == j - begins[col])
            row, col, piece = row[hit], col[hit], self.key_rank[at[hit]]
            before = last[row, begins[col]]
            fits = np.ones(len(row), bool)
            inner = np.flatnonzero((begins[col] > 0) & (before >= 0))
            fits[inner] = self._stays(before[inner], piece[inner])
            score = np.full((n, width), -np.inf)
            score[row[fits], col[fits]] = piece[fits]
            best = score.argmax(axis=1)
            found = score[np.arange(n), best]
            known = found > -np.inf
            last[known, j] = found[known]
            back[known, j] = j - begins[best[known]]
            last[~known, j] = -1 - codes[~known, j - 1].astype(np.int64)
        # Back from the ends, all words at once; a word that is done stays at 0.
        path, at, rows = np.full((n, size), _NONE), np.full(n, size), np.arange(n)
        for k in range(size - 1, -1, -1):
            live = at > 0
            if not live.any():
                break
            path[live, k] = last[rows[live], at[live]]
            at[live] -= back[rows[live], at[live]]
        used = path != _NONE
        return path[used], used.sum(axis=1)

    def _cut(self, word: str) -> list[str]:
        """Parts that no merge can join."""
        parts = self.before_mark.split(word)
        if len(word) > 24:
            parts = [q for p in parts for q in ([p] if len(p) <= 24 else self._cut_long(p))]
        return [p for p in parts if p]

    def _cut_long(self, word: str) -> list[str]:
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.spanned]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _ids(self, ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks to ids, and characters without a piece to byte pieces."""
        known = ranks >= 0
        if known.all():
            return self.piece_id[ranks], sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = [[int(self.piece_id[r])] if r >= 0 else self.byte_ids[list(chr(-1 - r).encode("utf-8", "surrogatepass"))].tolist() for r in ranks.tolist()]
        many = np.fromiter(map(len, out), np.int64, len(out))
        return np.array([i for x in out for i in x]), np.bincount(owner, many, len(sizes)).astype(np.int64)

    def _run(self, n: int) -> list[int]:
        """Ids of n spaces in a row: these merge after all else."""
        return [self.runs.get(p, self.vocab.get(p)) for p in merge([MARK] * n, self.run_rank)[0]]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of words, those of one length together."""
        by_size: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            by_size.setdefault(len(p), []).append(k)
        ids, owners = [], []
        for size, group in by_size.items():
            step = max(1, 400_000 // (size * self.longest))
            for k in range(0, len(group), step):
                some = group[k : k + step]
                if size > LONGEST:
                    got = [[i for s in merge(list(parts[j]), self.merges)[0] for i in ([self.vocab[s]] if s in self.vocab else self.byte_ids[list(s.encode("utf-8", "surrogatepass"))].tolist())] for j in some]
                    found, sizes = np.array([i for x in got for i in x]), np.array(list(map(len, got)))
                else:
                    found, sizes = self._ids(*self._search([parts[j] for j in some]))
                ids.append(found)
                owners.append(np.repeat(some, sizes))
        owner = np.concatenate(owners)
        return np.concatenate(ids)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(parts))

    def encode_words(self, words: list[str], cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it if it doesn't start with a line feed; further spaces at its start belong to it."""
        parts = [self._cut(w if w[:1] == "\n" else MARK + w.lstrip(" ")) for w in words]
        ids, ends = cache.ids([p for ps in parts for p in ps])
        at = ends[np.cumsum([0, *map(len, parts)])]
        spaced = [k for k, w in enumerate(words) if w[:1] == " "]
        if not spaced:
            return ids, np.diff(at)
        out, mark = [ids[a:b] for a, b in zip(at, at[1:])], self.vocab[MARK]
        for k in spaced:  # spaces before the last one merge after all else, and with it only where it stands alone
            n = len(words[k]) - len(words[k].lstrip(" "))
            alone = int(out[k][0] == mark)
            out[k] = np.concatenate([self._run(n + alone), out[k][alone:]])
        return np.concatenate(out), np.array(list(map(len, out)))


class PieceCodec:
    """encode() and decode() of whole texts."""

    _RUN = re.compile(r"  | \Z|\A | \n")

    def __init__(self, model: PieceModel):
        self.model = model
        dtype = "<u2" if len(model.text) <= 2**16 else "<u4"
        self.parts = WordCache(model.encode_parts, dtype, 150_000)
        self.words = WordCache(lambda words: model.encode_words(words, self.parts), dtype, 50_000)
        self.table = WordTable(lambda words: model.encode_words(words, self.parts), dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces, odd, plain, out = [], [], [], [np.zeros(0, self.words.dtype)] * len(texts)
        for k, t in enumerate(texts):
            # A line feed has no piece, so no merge crosses it; what starts with one is a word without a space before it.
            t = t.replace(MARK, " ")
            if t and self._RUN.search(t):
                odd.append(k)
                pieces.append([w for spaces, rest in re.findall(r" ( *)([^ ]*)", " " + t) for w in ((spaces, rest) if rest[:1] == "\n" else (spaces + rest,))])
            elif t:
                plain.append((k, t))
        for k, x in zip(odd, self.words.texts(pieces)):
            out[k] = x
        if plain:
            raw, starts, ends, first = cut_at_spaces([t for _, t in plain])
            ids, upto = self.table.ids(raw, starts, ends)
            for (k, _), a, b in zip(plain, upto[first].tolist(), upto[first[1:]].tolist()):
                out[k] = ids[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = self.model.text
        return b"".join([text[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


_CODEC: dict[str, PieceCodec] = {}


def shared_codec(path: str, model) -> PieceCodec:
    """One for each worker: the words that a task has met serve the next."""
    if path not in _CODEC:
        _CODEC.clear()
        _CODEC[path] = PieceCodec(model.value)
    return _CODEC[path]


def _shared(spark: SparkSession, path: str):
    """The model's tables, a few MB for any input, built once."""
    return spark.sparkContext.broadcast(PieceModel(path))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces), ids_crc32 (as little-endian unsigned 32 bits) and round_trip for each document, and ids if asked for.

    round_trip: the ids decode to the text, in which U+2581 counts as the space that the model takes it for. Null and empty
    texts have no ids and round_trip true.
    """
    model = _shared(docs.sparkSession, path)
    schema = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path, model)
        is_byte = np.zeros(len(codec.model.text), bool)
        is_byte[codec.model.byte_ids] = True
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) + 16 for t in texts]) // CHUNK
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1) if texts else ():
                some = [texts[k] for k in part]
                ids = codec.encode(some)
                row = {
                    "doc_id": doc_ids.slice(part[0], len(part)).cast(pa.int64()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "n_bytes": pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "round_trip": pa.array([codec.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, some)]),
                }
                if with_ids:
                    row["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(row)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: doc_id, n_tokens, n_bytes, ids_crc32, round_trip.

    Null and empty texts have no ids (a checksum of nothing, 0) and round_trip true. Each row is encoded by itself, whatever
    its doc_id. An empty table gives no rows.
    """
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
