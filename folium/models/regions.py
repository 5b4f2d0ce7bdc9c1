"""Stamps and signatures on page images by their colour, crops of them, and boxes drawn onto pages. Pixels are numpy; what is told from boxes is a column expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import geometry
from folium.models.png import decode, encode

# Ranges of hue, saturation and value of blue and red ink (hue in half degrees), the side of the square that closes gaps, and the colour of drawn boxes.
INK = (((90, 40, 40), (140, 255, 255)), ((0, 40, 40), (12, 255, 255)), ((165, 40, 40), (180, 255, 255)))
CLOSE = 5
COLOR = (255, 180, 0)
NOTE = "Found by colour and shape only; check by hand."
UNREADABLE = "Image unreadable"


def hsv(pixels: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value to 255."""
    rgb = pixels.astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = np.where(top > low, top - low, 1)
    r, g, b = (rgb[:, :, k] for k in range(3))
    hue = np.select([top == low, top == r, top == g], [0, 60 * (g - b) / span, 120 + 60 * (b - r) / span], 240 + 60 * (r - g) / span)
    saturation = np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1), 0)
    return np.stack([np.rint((hue % 360) / 2) % 180, np.rint(saturation), top], axis=2).astype(np.int64)


def _spread(mask: np.ndarray) -> np.ndarray:
    """Set where a pixel of the square around is set."""
    half, out = CLOSE // 2, mask
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)])
        out = np.any([np.take(wide, range(k, k + mask.shape[axis]), axis=axis) for k in range(CLOSE)], axis=0)
    return out


def ink(pixels: np.ndarray) -> np.ndarray:
    """Where blue or red ink is, with small gaps closed."""
    colors = hsv(pixels)
    mask = np.zeros(pixels.shape[:2], bool)
    for low, high in INK:
        mask |= ((colors >= low) & (colors <= high)).all(axis=2)
    return ~_spread(~_spread(mask))


def _labels(mask: np.ndarray, corners: bool) -> np.ndarray:
    """A number for each connected area of a mask, 0 elsewhere; corners: pixels that touch at a corner are connected."""
    starts = np.argwhere(np.diff(np.pad(mask, ((0, 0), (1, 0))).astype(np.int8), axis=1) == 1)
    ends = np.argwhere(np.diff(np.pad(mask, ((0, 0), (0, 1))).astype(np.int8), axis=1) == -1)
    parent = list(range(len(starts)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = np.searchsorted(starts[:, 0], np.arange(mask.shape[0] + 1)) if len(starts) else np.zeros(mask.shape[0] + 1, int)
    reach = int(corners)
    for y in range(1, mask.shape[0]):
        i, j = int(rows[y - 1]), int(rows[y])
        while i < rows[y] and j < rows[y + 1]:
            if ends[i, 1] + reach >= starts[j, 1] and ends[j, 1] + reach >= starts[i, 1]:
                parent[root(j)] = root(i)
            if ends[i, 1] < ends[j, 1]:
                i += 1
            else:
                j += 1
    out = np.zeros(mask.shape, np.int64)
    for k, ((y, a), (_, b)) in enumerate(zip(starts.tolist(), ends.tolist())):
        out[y, a : b + 1] = root(k) + 1
    return out


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, width and height of the areas that no other area surrounds; from the bottom of the image up, by their first pixel."""
    wide = np.pad(mask, 1)
    areas, ground = _labels(wide, True), _labels(~wide, False)
    y, x = np.nonzero(areas)
    _, first, at = np.unique(areas[y, x], return_index=True, return_inverse=True)
    low, high = np.stack([x[first], y[first]]), np.stack([x[first], y[first]])
    for k, v in enumerate((x, y)):
        np.minimum.at(low[k], at, v)
        np.maximum.at(high[k], at, v)
    free = ground[y[first] - 1, x[first]] == ground[0, 0]
    return [tuple(r) for r in np.concatenate([low - 1, high - low + 1]).T[free][::-1].tolist()]


def detected(pages: DataFrame) -> DataFrame:
    """document_id, page, stamp_present, signature_present, regions (place, kind, box, crop as PNG) and confidence_notes of each page; pages has document_id, page and image.

    Flags are null without regions. An image that can't be read has none and says so.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, p, content in frame.itertuples(index=False):
                try:
                    pixels = decode(content)
                    area = float(pixels.shape[0] * pixels.shape[1])
                    out.append((d, p, content, [dict(zip("xywh", b)) for b in boxes(ink(pixels))], area, NOTE))
                except ValueError:
                    out.append((d, p, content, [], 0.0, UNREADABLE))
            yield pd.DataFrame(out, columns=["document_id", "page", "image", "contours", "area", "confidence_notes"])

    found = pages.select("document_id", "page", "image").mapInPandas(find, "document_id string, page int, image binary, contours array<struct<x:int,y:int,w:int,h:int>>, area double, confidence_notes string")
    found = found.withColumn("regions", geometry.regions(F.col("contours"), F.col("area"))).drop("contours", "area")

    def crop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for content, regions in zip(frame["image"], frame["regions"]):
                pixels = decode(content) if len(regions) else None
                made.append([{**r, "crop": encode(pixels[r["box"][1] : r["box"][3], r["box"][0] : r["box"][2]])} for r in regions])
            yield frame.assign(regions=made).drop(columns="image")

    schema = "document_id string, page int, confidence_notes string, regions array<struct<place:int,kind:string,box:array<int>,crop:binary>>"
    out = found.mapInPandas(crop, schema)
    flags = [geometry.any_kind(F.col("regions"), k).alias(f"{k}_present") for k in ("stamp", "signature")]
    return out.select("document_id", "page", *flags, "regions", "confidence_notes")


def draw(pixels: np.ndarray, polygon: list[tuple[int, int]]) -> None:
    """The closed line of a polygon, two pixels wide, onto the pixels."""
    height, width = pixels.shape[:2]
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
            inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
            pixels[(y + dy)[inside], (x + dx)[inside]] = COLOR


def annotated(pages: DataFrame) -> DataFrame:
    """The columns but image and polygons, and annotated: the image with the polygons drawn, null where it can't be read or has none.

    pages has image and polygons (arrays of points, null where a box couldn't be understood).
    """
    keep = [f for f in pages.schema if f.name not in ("image", "polygons")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", annotated binary"

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content, polygons in zip(frame["image"], frame["polygons"]):
                known = [[(int(p["x"]), int(p["y"])) for p in polygon] for polygon in (polygons if polygons is not None else []) if polygon is not None and len(polygon)]
                try:
                    pixels = decode(content) if known else None
                except ValueError:
                    pixels = None
                if pixels is None:
                    out.append(None)
                    continue
                for polygon in known:
                    draw(pixels, polygon)
                out.append(encode(pixels))
            yield frame[[f.name for f in keep]].assign(annotated=out)

    return pages.select(*[f.name for f in keep], "image", "polygons").mapInPandas(mark, schema)
