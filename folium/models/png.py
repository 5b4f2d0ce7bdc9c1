"""Images as arrays: PNG by itself, other formats where an image library is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(content: bytes):
    at = 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    kinds = lines[:, 0]
    if (kinds > 4).any():
        raise ValueError("not an image")
    if (kinds > 2).any():
        return _by_diagonals(kinds, lines[:, 1:].reshape(height, stride // step, step))
    out, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = lines[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + before
        out[y] = before = line
    return out


def _by_diagonals(kinds: np.ndarray, given: np.ndarray) -> np.ndarray:
    """A pixel needs those to its left, above, and left above: so all of one diagonal are made at once, whatever their rows' filters."""
    height, width, n = given.shape
    # A row and a column of zeros stand before the others; from one row to the next, a diagonal goes on so many pixels.
    wide = np.zeros(((height + 1) * (width + 1), n), np.int16)
    for d in range(height + width - 1):
        top, count = max(0, d - width + 1), min(height - 1, d) - max(0, d - width + 1) + 1
        first = (top + 1) * (width + 1) + d - top + 1
        a, b, c = (wide[first - k :: width][:count] for k in (1, width + 1, width + 2))
        rows = np.arange(top, top + count)
        p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
        guess = np.choose(kinds[rows][:, None], (np.zeros_like(a), a, b, (a + b) >> 1, nearest))
        wide[first::width][:count] = (given[rows, d - rows] + guess) & 255
    return wide.reshape(height + 1, width + 1, n)[1:, 1:].astype(np.uint8).reshape(height, width * n)


def decode(content: bytes | None) -> np.ndarray:
    """RGB pixels, height by width by 3; transparency is left out. What can't be read raises ValueError."""
    content = bytes(content or b"")
    if content.startswith(_SIGNATURE):
        parts = list(_chunks(content))
        width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
        if depth == 8 and not interlaced and color in _CHANNELS:
            n = _CHANNELS[color]
            try:
                raw = zlib.decompress(b"".join(data for kind, data in parts if kind == b"IDAT"))
                pixels = _unfiltered(raw, height, width * n, n).reshape(height, width, n)
            except (zlib.error, IndexError, ValueError) as e:
                raise ValueError("not an image") from e
            if color == 3:
                palette = np.frombuffer(next(data for kind, data in parts if kind == b"PLTE"), np.uint8).reshape(-1, 3)
                return palette[pixels[:, :, 0]]
            return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3].copy()
    try:
        from PIL import Image

        return np.array(Image.open(io.BytesIO(content)).convert("RGB"))
    except ImportError:
        pass
    except Exception as e:
        raise ValueError("not an image") from e
    try:
        import cv2
    except ImportError as e:
        raise ValueError("not an image that can be read without an image library") from e
    found = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_COLOR)
    if found is None:
        raise ValueError("not an image")
    return found[:, :, ::-1].copy()


def encode(pixels: np.ndarray) -> bytes:
    """RGB pixels, or grey ones, as PNG."""
    height, width = pixels.shape[:2]
    flat = pixels.reshape(height, -1)
    rows = np.zeros((height, flat.shape[1] + 1), np.uint8)
    rows[:, 1:] = flat

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    color = 2 if pixels.ndim == 3 else 0
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
