"""Token ids in blocks: a concatenated id array with Elias-Fano encoded document boundaries.

A block is a row of a Parquet table: the ids of some documents in a row (2 bytes an id where the vocabulary allows, else
4), the ends of the documents and the documents' own ids, both as Elias-Fano sequences. The ends take about 2 + log2(ids a
document) bits a document, in place of 64. Positions of every 64th one bit are kept, so that select() reads a document's
offset without decoding the others. Tables are written by Spark's committed writer: a lost executor's blocks are written
again, never twice.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import documents, numbered, partitions, work_dir
from folium.llm.word_cache import WordCache, WordTable, cut_at_spaces

END = 2
#: Ids in a block, if it holds more than one document.
BLOCK = 1 << 20
#: Characters that are encoded together.
CHUNK = 1 << 20
_STEP = 64
_EF = "low_bits int, low binary, high binary, ones binary"
#: The ids of a block's documents: no_ids of them have none and come first, the others are above least_id as a sequence of their own.
_BLOCKS = f"part int, block int, first long, n_docs int, n_tokens long, width int, no_ids int, least_id long, id_of struct<{_EF}>, end_of struct<{_EF}>, ids binary"


class EliasFano:
    """A non-decreasing sequence of n unsigned numbers of 64 bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, ones: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones = low, high, np.frombuffer(ones, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, values = len(values), values.astype("u8")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits, dtype="u8")) & np.uint64(1) if low_bits else np.zeros((n, 0))
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::_STEP].astype("<u4").tobytes())

    def select(self, k: int) -> int:
        """The k-th number: from the sampled one bit before it, count on in the high bits, 64 at a time."""
        at, left = int(self.ones[k // _STEP]), k % _STEP
        byte = at >> 3
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> (at & 7) << (at & 7)
        while left >= (n := word.bit_count()):
            left -= n
            byte += 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - k
        if not self.low_bits:
            return high
        first = k * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low


class ByteBpe:
    """Ids of a byte-level BPE with the usual pre-tokens, by the tokenizers library.

    No pre-token spans a single space or line feed between two other characters but at its start, so a text is cut there
    and each distinct piece is encoded once. Pieces are encoded as one long text and told apart by the tokens that start
    with a space or line feed; pieces with more white space in them, and a text's first piece, are encoded on their own.
    Texts that hold an added token's string (such as the end of a text) go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile("|".join(map(re.escape, sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))) or r"(?!)")
        vocab = self.tokenizer.get_vocab()
        self.dtype = "<u2" if max(vocab.values()) < 2**16 else "<u4"
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.fed = np.zeros_like(self.spaced)
        self.fed[vocab["Ċ"]] = True
        self.table = WordTable(self._pieces, self.dtype)
        self.words, self.firsts = WordCache(self._pieces, self.dtype, 200_000), WordCache(self._texts, self.dtype, 50_000)

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in got], np.int64)
        return np.concatenate([np.array(x, np.int64) for x in got] or [np.zeros(0, np.int64)]), sizes

    def _together(self, words: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that can be told apart by the tokens they start with, encoded as a few long texts."""
        ids, _ = self._texts(["".join(words[k : k + 2000]) for k in range(0, len(words), 2000)])
        at = np.flatnonzero(starts[ids])
        if len(at) != len(words):
            return self._texts(words)
        return ids, np.diff(np.append(at, len(ids)))

    _WHITE = re.compile(r"\s")

    def _alone(self, words: list[str]) -> list[bool]:
        """Whether a piece is short of a character or has more white space than at its start."""
        out = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            if len("".join(some).split()) == len(some):  # each starts with its only white space
                out += [False] * len(some)
            else:
                out += [len(w) < 2 or self._WHITE.search(w, 1) is not None for w in some]
        return out

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with their space put back: those that start with a line feed stand without one."""
        full = [w if w[:1] == "\n" else " " + w for w in words]
        kind = np.array([w[0] == "\n" for w in full], np.int64)
        kind[np.array(self._alone(full), bool)] = 2
        ids, owners, sizes = [], [], np.zeros(len(full), np.int64)
        for k, encode in enumerate((lambda x: self._together(x, self.spaced), lambda x: self._together(x, self.fed), self._texts)):
            at = np.flatnonzero(kind == k)
            if len(at):
                got, sizes[at] = encode([full[i] for i in at] if len(at) < len(full) else full)
                ids.append(got)
                owners.append(np.repeat(at, sizes[at]))
        return ids[0] if len(ids) == 1 else np.concatenate(ids)[np.argsort(np.concatenate(owners), kind="stable")], sizes

    _DOUBLE, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, odd, whole = [], [], []
        for k, t in enumerate(texts):
            if self.added.search(t):
                whole.append(k)
            else:
                (odd if not t or t[0].isspace() or t[-1].isspace() or self._DOUBLE.search(t) else plain).append(k)
        for k in whole:
            out[k] = self._texts([texts[k]])[0].astype(self.dtype)
        if plain:
            self._plain([texts[k] for k in plain], plain, out)
        pieces = [self._CUT.split(texts[k]) for k in odd]
        for k, a, b in zip(odd, self.firsts.texts([p[:1] for p in pieces]), self.words.texts([p[1:] for p in pieces])):
            out[k] = np.concatenate([a, b])
        return out

    def _plain(self, texts: list[str], at: list[int], out: list[np.ndarray | None]) -> None:
        """Texts without white space at their ends or next to each other: cut at all spaces, and before line feeds."""
        raw, starts, ends, first = cut_at_spaces(texts)
        edges, first = first, first[:-1]
        rest = np.ones(len(starts), bool)
        rest[first] = False
        ids, upto = self.table.ids(raw, starts[rest], ends[rest])
        edges = upto[edges - np.arange(len(edges))]
        heads = self.firsts.texts([[raw[a:b].decode("utf-8", "surrogatepass")] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        for k, head, a, b in zip(at, heads, edges.tolist(), edges[1:].tolist()):
            out[k] = np.concatenate([head, ids[a:b]])


_BPE: dict[str, ByteBpe] = {}


def shared_bpe(path: str) -> ByteBpe:
    """One for each worker: the words that a task has met serve the next."""
    if path not in _BPE:
        _BPE.clear()
        _BPE[path] = ByteBpe(path)
    return _BPE[path]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc ids and texts, CHUNK characters or one document at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(t.as_py() or "")
            size += len(texts[-1]) + 16
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _packed(ef: EliasFano) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([ef.low_bits], pa.int32()), *(pa.array([x], pa.binary()) for x in (ef.low, ef.high, ef.ones.tobytes()))], names=["low_bits", "low", "high", "ones"])


def _block(part: int, number: int, first: int, doc_ids: list[int | None], docs: list[np.ndarray], dtype: str) -> pa.RecordBatch:
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    least = known[0] if len(known) else np.int64(0)
    row = {
        "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(docs)], pa.int32()),
        "n_tokens": pa.array([sum(map(len, docs))], pa.int64()), "width": pa.array([np.dtype(dtype).itemsize], pa.int32()), "no_ids": pa.array([len(docs) - len(known)], pa.int32()),
        "least_id": pa.array([least], pa.int64()), "id_of": _packed(EliasFano.of(known.view("u8") - least.view("u8"))),
        "end_of": _packed(EliasFano.of(np.cumsum([len(x) for x in docs], dtype=np.int64))), "ids": pa.array([np.concatenate(docs).astype(dtype).tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row)


class Block:
    """A block that is read: documents by their place in it, through select()."""

    def __init__(self, row: dict):
        self.row, self.n = row, row["n_docs"]
        self.ids = np.frombuffer(row["ids"], f"<u{row['width']}")
        self.id_of, self.end_of = (EliasFano(n, x["low_bits"], x["low"], x["high"], x["ones"]) for n, x in ((self.n - row["no_ids"], row["id_of"]), (self.n, row["end_of"])))

    def doc_id(self, k: int) -> int | None:
        return None if k < self.row["no_ids"] else self.row["least_id"] + self.id_of.select(k - self.row["no_ids"])

    def bounds(self, k: int) -> tuple[int, int]:
        """Where the k-th document starts and ends among the ids of the block."""
        return self.end_of.select(k - 1) if k else 0, self.end_of.select(k)


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write the ids of all documents, in ascending doc_id order, end appended to each; null doc_ids come first, null texts are empty.

    Rows of one doc_id, or of none, may be many: they are dealt to several tasks by a number of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = shared_bpe(tokenizer), TaskContext.get().partitionId()
        number = first = held = 0
        ids: list[int] = []
        held_docs: list[np.ndarray] = []
        for doc_ids, texts in _chunks(batches):
            for i, x in zip(doc_ids, bpe.encode(texts)):
                ids.append(i)
                held_docs.append(np.append(x, np.array([end], x.dtype)))
                held += len(x) + 1
                if held >= BLOCK:
                    yield _block(part, number, first, ids, held_docs, bpe.dtype)
                    number, first, held, ids, held_docs = number + 1, first + held, 0, [], []
        if ids:
            yield _block(part, number, first, ids, held_docs, bpe.dtype)

    keyed = numbered(docs.select("doc_id", "text"), "folium_row")
    ordered = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "folium_row").sortWithinPartitions("doc_id", "folium_row")
    ordered.select("doc_id", "text").mapInArrow(encode, _BLOCKS).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the blocks.

    What is gathered on the driver is a number for each partition of the writer.
    """
    blocks = spark.read.parquet(path)
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, part_start long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r)
                bounds = np.array([block.bounds(k) for k in range(block.n)], np.int64)
                ids = block.ids.astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([block.doc_id(k) for k in range(block.n)], pa.int64()),
                        "start": pa.array(bounds[:, 0] + r["first"] + r["part_start"], pa.int64()),
                        "n_tokens": pa.array(bounds[:, 1] - bounds[:, 0], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in bounds.tolist()], pa.int64()),
                    }
                )

    rows = blocks.join(F.broadcast(starts), "part").select("first", "part_start", "n_docs", "width", "no_ids", "least_id", "id_of", "end_of", "ids")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token ids of all documents and reads the files back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Null doc_ids come first; rows that share a doc_id stand side by side, in an order
    that stays as long as the files do. Very long texts are encoded alone. Other columns are not read. An empty table gives no rows.
    """
    import uuid

    import public_tokenizers

    path = f"{work_dir(spark)}/folium/tokens-{uuid.uuid4().hex}"
    write_blocks(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
