"""Pages of scanned PDFs: the data source `scanned_pdf`, whose partitions are ranges of pages.

    spark.dataSource.register(ScannedPdf)
    spark.read.format("scanned_pdf").load("/scans")                          # every page
    spark.read.format("scanned_pdf").option("first_only", True).load(path)   # page 1, nothing else is read

A scanned page is its largest image: a JPEG comes as it is, other pixels as PNG. Objects are found through cross-reference
tables and streams and read one by one, so a page costs its own bytes whatever the file's size.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folium.models import png

SCHEMA = "document_id string, path string, page int, n_pages int, image binary, error string"
#: Bytes of files, or of a file's pages, that a partition takes.
SPLIT = 64 << 20
#: Bytes that are read at first to find an object, and how deep a page tree may be.
_READ, _DEEP = 4096, 64
_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")


class Name(str):
    """A name object."""


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    info: dict
    raw: bytes


class Short(Exception):
    """The bytes end before the object does."""


class _Parser:
    """Objects out of bytes, from a place on."""

    def __init__(self, data: bytes, at: int = 0, whole: bool = True):
        self.data, self.at, self.whole = data, at, whole

    def _end(self) -> Exception:
        return ValueError("broken PDF object") if self.whole else Short()

    def space(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c == 37:  # a comment, up to the line's end
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            elif c in _SPACE:
                self.at += 1
            else:
                return
        raise self._end()

    def token(self) -> bytes:
        m = _TOKEN.match(self.data, self.at)
        if not m or (m.end() == len(self.data) and not self.whole):
            raise self._end() if not m and self.at >= len(self.data) or m else ValueError("broken PDF object")
        self.at = m.end()
        return m[0]

    def value(self) -> Any:
        self.space()
        two = self.data[self.at : self.at + 2]
        if two == b"<<":
            self.at += 2
            out = {}
            while True:
                self.space()
                if self.data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value()
                if not isinstance(key, Name):
                    raise ValueError("broken PDF object")
                out[key] = self.value()
        if two[:1] == b"[":
            self.at += 1
            items: list = []
            while True:
                self.space()
                if self.data[self.at] == 93:
                    self.at += 1
                    return items
                items.append(self.value())
        if two[:1] == b"/":
            self.at += 1
            m = _TOKEN.match(self.data, self.at)
            raw = m[0] if m else b""
            self.at += len(raw)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if two[:1] == b"<":
            end = self.data.find(b">", self.at)
            if end < 0:
                raise self._end()
            digits = re.sub(rb"\s", b"", self.data[self.at + 1 : end]).decode("latin-1")
            self.at = end + 1
            return bytes.fromhex(digits + "0" * (len(digits) % 2))
        if two[:1] == b"(":
            return self._string()
        word = self.token()
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word]
        try:
            number = int(word)
        except ValueError:
            try:
                return float(word)
            except ValueError as e:
                raise ValueError("broken PDF object") from e
        m = re.match(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])", self.data[self.at : self.at + 24])
        if not m:
            return number
        self.at += m.end()
        return Ref(number, int(m[1]))

    def _string(self) -> bytes:
        """A literal string; its escapes stay, as no text is read out of one."""
        depth, start = 0, self.at
        while self.at < len(self.data):
            c = self.data[self.at]
            self.at += 2 if c == 92 else 1
            depth += (c == 40) - (c == 41)
            if not depth:
                return self.data[start + 1 : self.at - 1]
        raise self._end()


class Document:
    """A PDF in a file that can be searched; ValueError where it isn't one, or is broken or encrypted."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        #: By number: ("at", offset) or ("in", number of an object stream, place in it).
        self.places: dict[int, tuple] = {}
        self.trailer: dict = {}
        self._streams: dict[int, tuple[list, bytes, int]] = {}
        tail = self._read(max(0, self.size - 2048), 2048)
        found = re.findall(rb"startxref\s+(\d+)", tail)
        if not found:
            raise ValueError("no PDF")
        self._sections(int(found[-1]))
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted PDF")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _parsed(self, at: int, parse):
        """parse(parser) over as many bytes from a place on as it takes."""
        n = _READ
        while True:
            data = self._read(at, n)
            try:
                return parse(_Parser(data, 0, len(data) < n))
            except (Short, IndexError) as e:
                if len(data) < n:
                    raise ValueError("broken PDF object") from e
                n *= 8

    def _sections(self, at: int | None) -> None:
        """Cross-reference sections, the newest first: what it says of an object stays."""
        seen = set()
        while at is not None and at not in seen and 0 <= at < self.size:
            seen.add(at)
            info = self._table(at) if self._read(at, 64).lstrip(_SPACE).startswith(b"xref") else self._xref_stream(at)
            if isinstance(info.get("XRefStm"), int):
                self._xref_stream(info["XRefStm"])
            self.trailer = {**info, **self.trailer}
            at = info.get("Prev")
        if "Root" not in self.trailer:
            raise ValueError("broken PDF")

    def _table(self, at: int) -> dict:
        def parse(p: _Parser) -> dict:
            p.space()
            p.token()
            found = {}
            while True:
                p.space()
                word = p.token()
                if word == b"trailer":
                    info = p.value()
                    for number, place in found.items():
                        self.places.setdefault(number, place)
                    return info
                first = int(word)
                p.space()
                for number in range(first, first + int(p.token())):
                    fields = []
                    for _ in range(3):
                        p.space()
                        fields.append(p.token())
                    if fields[2] == b"n":
                        found[number] = ("at", int(fields[0]))

        return self._parsed(at, parse)

    def _xref_stream(self, at: int) -> dict:
        got = self._object_at(at)
        if not isinstance(got, Stream) or got.info.get("Type") != "XRef":
            raise ValueError("broken PDF")
        data, info = self._decoded(got), got.info
        widths = info["W"]
        index = info.get("Index", [0, info["Size"]])
        row, k = sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                fields, x = [], k * row
                for w in widths:
                    fields.append(int.from_bytes(data[x : x + w], "big"))
                    x += w
                kind = fields[0] if widths[0] else 1
                if kind == 1:
                    self.places.setdefault(number, ("at", fields[1]))
                elif kind == 2:
                    self.places.setdefault(number, ("in", fields[1], fields[2]))
                k += 1
        return info

    def _object_at(self, at: int) -> Any:
        def parse(p: _Parser) -> tuple[Any, int | None]:
            for _ in range(3):  # number, generation, obj
                p.space()
                p.token()
            value = p.value()
            if isinstance(value, dict):
                p.space()
                if p.data[p.at : p.at + 6] == b"stream":
                    p.at += 6
                    if len(p.data) < p.at + 2:
                        raise Short
                    p.at += 2 if p.data[p.at : p.at + 2] == b"\r\n" else 1
                    return value, at + p.at
            return value, None

        value, start = self._parsed(at, parse)
        if start is None:
            return value
        return Stream(value, self._read(start, self.get(value.get("Length", 0))))

    def get(self, value: Any) -> Any:
        """What a reference stands for; anything else itself."""
        for _ in range(_DEEP):
            if not isinstance(value, Ref):
                return value
            place = self.places.get(value.number)
            if place is None:
                return None
            value = self._object_at(place[1]) if place[0] == "at" else self._packed(*place[1:])
        raise ValueError("broken PDF")

    def _packed(self, stream: int, k: int) -> Any:
        if stream not in self._streams:
            got = self.get(Ref(stream, 0))
            if not isinstance(got, Stream):
                raise ValueError("broken PDF")
            data, first = self._decoded(got), got.info["First"]
            heads = [int(x) for x in data[:first].split()]
            self._streams = {stream: (heads[1::2], data, first)}  # pages follow each other, so one is kept
        offsets, data, first = self._streams[stream]
        return _Parser(data, first + offsets[k]).value()

    def _filters(self, info: dict) -> list[tuple[str, dict]]:
        names, parms = self.get(info.get("Filter")), self.get(info.get("DecodeParms"))
        names = [] if names is None else names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms] * len(names)
        return [(self.get(n), self.get(p) or {}) for n, p in zip(names, [*parms, *[None] * len(names)])]

    def _decoded(self, stream: Stream) -> bytes:
        data = stream.raw
        for name, parms in self._filters(stream.info):
            if name != "FlateDecode":
                raise ValueError(f"PDF filter {name} is not supported")
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error as e:
                raise ValueError("broken PDF stream") from e
            if parms.get("Predictor", 1) >= 10:
                n, bits = parms.get("Colors", 1), parms.get("BitsPerComponent", 8)
                stride, step = -(-parms.get("Columns", 1) * n * bits // 8), max(1, n * bits // 8)
                height = len(data) // (stride + 1)
                data = png._unfiltered(data[: height * (stride + 1)], height, stride, step).tobytes()
            elif parms.get("Predictor", 1) != 1:
                raise ValueError("PDF predictor is not supported")
        return data

    def n_pages(self) -> int:
        return int(self.get(self._pages().get("Count")) or 0)

    def _pages(self) -> dict:
        root = self.get(self.trailer["Root"])
        pages = self.get(root.get("Pages")) if isinstance(root, dict) else None
        if not isinstance(pages, dict):
            raise ValueError("broken PDF")
        return pages

    def page(self, number: int) -> dict:
        """A page's resources, page 1 first; only the branches of the tree on its way are read."""
        node, left, resources = self._pages(), number - 1, None
        for _ in range(_DEEP):
            resources = node.get("Resources", resources)
            if "Kids" not in node:
                return self.get(resources) or {}
            for kid in self.get(node["Kids"]):
                kid = self.get(kid)
                count = int(self.get(kid.get("Count", 0))) if "Kids" in kid else 1
                if left < count:
                    node = kid
                    break
                left -= count
            else:
                break
        raise ValueError("no such page")

    def image(self, number: int) -> bytes:
        """The page's largest image; ValueError if it has none, or none that can be read."""
        found = [self.get(x) for x in (self.get(self.page(number).get("XObject")) or {}).values()]
        found = [x for x in found if isinstance(x, Stream) and x.info.get("Subtype") == "Image"]
        if not found:
            raise ValueError("page without an image")
        best = max(found, key=lambda x: self.get(x.info["Width"]) * self.get(x.info["Height"]))
        filters = self._filters(best.info)
        if filters and filters[-1][0] == "DCTDecode":
            plain = Stream({k: v for k, v in best.info.items() if k not in ("Filter", "DecodeParms")} | {"Filter": [n for n, _ in filters[:-1]]}, best.raw)
            return self._decoded(plain)
        return png.encode(self._pixels(best))

    def _pixels(self, image: Stream) -> np.ndarray:
        info = {k: self.get(v) for k, v in image.info.items()}
        width, height, bits = info["Width"], info["Height"], 1 if info.get("ImageMask") else info.get("BitsPerComponent", 8)
        space = info.get("ColorSpace", Name("DeviceGray"))
        kind, palette = (self.get(space[0]), space) if isinstance(space, list) else (space, None)
        n = {"DeviceGray": 1, "CalGray": 1, "Indexed": 1, "DeviceRGB": 3, "CalRGB": 3}.get(kind) or (kind == "ICCBased" and self.get(palette[1]).info["N"])
        if n not in (1, 3) or bits not in (1, 2, 4, 8):
            raise ValueError(f"PDF image of {kind} is not supported")
        data = np.frombuffer(self._decoded(image), np.uint8)
        stride = -(-width * n * bits // 8)
        if len(data) < stride * height:
            raise ValueError("broken PDF image")
        rows = data[: stride * height].reshape(height, stride)
        if bits < 8:
            rows = (np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)
        pixels = rows[:, : width * n].reshape(height, width, n)
        if kind == "Indexed":
            table = self.get(palette[3])
            table = np.frombuffer(self._decoded(table) if isinstance(table, Stream) else table, np.uint8)
            base = 1 if self.get(palette[1]) == "DeviceGray" else 3
            pixels = table[: len(table) // base * base].reshape(-1, base)[pixels[:, :, 0]]
        elif bits < 8:
            pixels = (pixels * (255 // ((1 << bits) - 1))).astype(np.uint8)
        if list(info.get("Decode") or [])[:2] == [1, 0]:
            pixels = 255 - pixels
        return pixels[:, :, 0] if pixels.shape[2] == 1 else pixels


def read_pages(file: BinaryIO, path: str, part: int = 0, parts: int = 1, first_only: bool = False) -> Iterator[tuple]:
    """Rows of one of so many even ranges of a file's pages. A broken file is one error row of the first range, a broken page a row of its own."""
    document_id = re.sub(r"\.[^./]*$", "", path.rstrip("/").rsplit("/", 1)[-1]).replace(" ", "_")
    try:
        pdf = Document(file)
        n = pdf.n_pages()
    except Exception as e:  # bytes of strangers can break anything
        if part == 0:
            yield document_id, path, 1, None, None, str(e) or type(e).__name__
        return
    first, last = (0, min(n, 1)) if first_only else (n * part // parts, n * (part + 1) // parts)
    for k in range(first + 1, last + 1):
        try:
            yield document_id, path, k, n, pdf.image(k), None
        except Exception as e:
            yield document_id, path, k, n, None, str(e) or type(e).__name__


def pages(content: bytes, first_only: bool = False) -> list[bytes]:
    """The images of a PDF's pages; the first one that can't be read raises ValueError."""
    out = []
    for *_, image, error in read_pages(io.BytesIO(content), "x", first_only=first_only):
        if error:
            raise ValueError(error)
        out.append(image)
    return out


class PageRange(InputPartition):
    """Files, each with a part of so many even parts of its pages."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class ScannedPdf(DataSource):
    """Options: path (a file or a folder), first_only, split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "scanned_pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.first_only = str(options.get("first_only", "false")).lower() == "true"
        self.split = int(options.get("split", SPLIT))

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[PageRange]:
        """Names and sizes only are listed here: small files together, ranges of pages of large ones."""
        from pyarrow import fs

        system, path = self._fs()
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            parts = 1 if self.first_only else max(1, -(-f.size // self.split))
            if parts > 1:
                out += [PageRange([(f.path, k, parts)]) for k in range(parts)]
                continue
            cost = min(f.size, _READ) if self.first_only else f.size
            if held and size + cost > self.split:
                out.append(PageRange(held))
                held, size = [], 0
            held.append((f.path, 0, 1))
            size += cost
        return [*out, PageRange(held)] if held or not out else out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        system, _ = self._fs()
        for path, part, parts in partition.files:
            with system.open_input_file(path) as file:
                yield from read_pages(file, path, part, parts, self.first_only)
