"""Image variants of scanned pages, in numpy: border crop, deskewing, denoising, local contrast, sharpening, binarisation.

Every step works on bands of rows of a bounded number of pixels where it needs several copies of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folium.models.png import decode, encode

# What is paper, the margin left around ink, and the share of a side that a crop keeps at least.
PAPER, MARGIN, LEAST_SIDE = 245, 10, 0.55
# Dark pixels that a page is turned for at least, and the angles that it is turned by, in degrees.
LEAST_DARK, LEAST_ANGLE, MOST_ANGLE = 100, 0.2, 10.0
# Strength, patch and search window of the denoising; clip limit and tiles of the contrast.
STRENGTH, PATCH, SEARCH = 12, 7, 21
CLIP, TILES = 2.0, 8
# Window of the local mean and what a pixel may be darker than it.
WINDOW, DARKER = 35, 11
#: Pixels that a step takes at once.
BAND = 1 << 18
#: A weight of exp(-LEAST_WEIGHT) is lost beside 1 in double precision; pages of two shades are counted by up to MOST_UNLIKE different places of two patches.
LEAST_WEIGHT, MOST_UNLIKE = 53 * np.log(2), 8
#: Bytes of images that leave a task at once, if no single page has more.
SENT = 1 << 22


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB pixels."""
    return np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def cropped(page: np.ndarray) -> np.ndarray:
    """Without the border around the ink, but for a margin; the page itself if it has no ink or too little would be left."""
    ink = page <= PAPER
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(rows):
        return page
    (top, bottom), (left, right) = ((max(int(at[0]) - MARGIN, 0), min(int(at[-1]) + 1 + MARGIN, size)) for at, size in zip((rows, columns), page.shape))
    if right - left < LEAST_SIDE * page.shape[1] or bottom - top < LEAST_SIDE * page.shape[0]:
        return page
    return page[top:bottom, left:right]


def otsu(page: np.ndarray) -> int:
    """The level that parts the histogram into two classes of the greatest variance between them; the upper class lies above it."""
    n = np.bincount(page.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below - sums * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


def hull(mask: np.ndarray) -> np.ndarray:
    """Corners (x, y) of the convex hull of the mask's pixels, counter-clockwise as y grows upwards; from the ends of each row."""
    rows = np.flatnonzero(mask.any(axis=1))
    first, last = mask[rows].argmax(axis=1), mask.shape[1] - 1 - mask[rows, ::-1].argmax(axis=1)
    points = np.unique(np.concatenate([np.stack([first, rows], axis=1), np.stack([last, rows], axis=1)]), axis=0).tolist()

    def chain(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(points), chain(points[::-1])
    return np.array(lower[:-1] + upper[:-1] if len(points) > 1 else points, np.float64)


def least_rectangle(corners: np.ndarray) -> tuple[float, float]:
    """Area and angle of the smallest rectangle around a convex polygon; the angle in degrees, above -45 and up to 45.

    One of its sides lies on an edge. Calipers turn with the edges: the corner that is farthest in a direction is where the
    polygon's edges, in order of their angles, pass that direction.
    """
    if len(corners) < 3:
        a, b = corners[0], corners[-1]
        return 0.0, _folded(np.degrees(np.arctan2(b[1] - a[1], b[0] - a[0])))
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.unwrap(np.arctan2(edges[:, 1], edges[:, 0]))
    along, across = np.stack([np.cos(angles), np.sin(angles)], axis=1), np.stack([-np.sin(angles), np.cos(angles)], axis=1)

    def farthest(turn: float) -> np.ndarray:
        """The corner that is farthest in the direction that is so far turned from each edge."""
        wanted = angles + turn + np.pi / 2
        at = np.searchsorted(angles, angles[0] + np.mod(wanted - angles[0], 2 * np.pi) - 1e-12)
        return corners[at % len(corners)]

    width = ((farthest(0.0) - farthest(np.pi)) * along).sum(axis=1)
    height = ((farthest(np.pi / 2) - corners) * across).sum(axis=1)
    best = int(np.argmin(width * height))
    return float(width[best] * height[best]), _folded(np.degrees(angles[best]))


def _folded(degrees: float) -> float:
    return float(45 - (45 - degrees) % 90)


def skew(page: np.ndarray) -> float:
    """By how many degrees the ink is turned: clockwise, as rows of an image go down. 0 with little ink."""
    dark = page <= otsu(page) if page.min() < page.max() else np.zeros(page.shape, bool)
    return least_rectangle(hull(dark))[1] if np.count_nonzero(dark) >= LEAST_DARK else 0.0


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours of a place that lies t after the second one; the usual kernel of parameter -0.75."""
    a = -0.75
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def turned(page: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned around its middle, counter-clockwise as one sees it, of the same size; what comes in is the page's edge."""
    height, width = page.shape
    c, s, mx, my = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), width // 2, height // 2
    out, step = np.empty_like(page), max(1, BAND // width)
    x = np.arange(width) - mx
    for top in range(0, height, step):
        y = np.arange(top, min(top + step, height))[:, None] - my
        from_x, from_y = c * x - s * y + mx, s * x + c * y + my
        left, up = np.floor(from_x).astype(np.int64), np.floor(from_y).astype(np.int64)
        columns = [np.clip(left + k, 0, width - 1) for k in (-1, 0, 1, 2)]
        weights, total = _cubic(from_x - left), np.zeros(left.shape)
        for k, w in zip((-1, 0, 1, 2), _cubic(from_y - up)):
            row = np.clip(up + k, 0, height - 1)
            total += w * sum(v * page[row, at] for v, at in zip(weights, columns))
        out[top : top + len(y)] = np.clip(np.rint(total), 0, 255)
    return out


def deskewed(page: np.ndarray) -> np.ndarray:
    """Turned so that its ink stands upright; angles too small to matter, or too large to be skew, stay."""
    angle = skew(page)
    return turned(page, angle) if LEAST_ANGLE <= abs(angle) <= MOST_ANGLE else page


def denoised(page: np.ndarray, strength: float = STRENGTH, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike their patches are.

    A weight is exp(-d / strength**2), d the mean squared difference of two patches. The differences of a whole band and its
    shifted copy are summed over patches by an integral image, so the work doesn't depend on the size of a patch. Pages of
    two shades, as most scans of text are that come black and white, go another way to the same values.
    """
    height, width = page.shape
    half, reach = patch // 2, search // 2
    low, high = int(page.min()), int(page.max())
    if low == high:
        return page.copy()
    fall = (high - low) ** 2 / (patch * patch * strength * strength)
    if patch * patch < 256 and fall * MOST_UNLIKE > LEAST_WEIGHT and ((page == low) | (page == high)).all():
        return _denoised_shades(page, fall, patch, search)
    wide = np.pad(page, half + reach, mode="reflect" if min(page.shape) > half + reach else "symmetric").astype(np.uint32)
    out, step = np.empty_like(page), max(1, BAND // 4 // (width + 2 * half))  # small enough for a core's cache
    shades = wide.astype(np.float32)
    scale = np.float32(-1.0 / (patch * patch * strength * strength))
    for top in range(0, height, step):
        rows = min(step, height - top)
        here = wide[top + reach : top + reach + rows + 2 * half, reach : reach + width + 2 * half]
        total, weights = np.zeros((rows, width)), np.zeros((rows, width))
        for dy in range(search):
            for dx in range(search):
                there = wide[top + dy : top + dy + rows + 2 * half, dx : dx + width + 2 * half]
                # Sums may wrap around at 2**32; a patch's sum is far below that.
                sums = np.zeros((rows + patch, width + patch), np.uint32)
                difference = here - there
                np.cumsum(difference * difference, axis=0, out=sums[1:, 1:])
                tall = sums[patch:] - sums[:-patch]
                np.cumsum(tall, axis=1, out=tall)
                w = np.exp((tall[:, patch:] - tall[:, :-patch]).astype(np.float32) * scale)
                total += w * shades[top + dy : top + dy + rows + 2 * half, dx : dx + width + 2 * half][half : half + rows, half : half + width]
                weights += w
        out[top : top + rows] = np.rint(total / weights)
    return out


def _sums(values: np.ndarray, size: int, step: int) -> np.ndarray:
    """From each place on, the sum of so many values, a step apart."""
    out, n = values, 1
    for bit in bin(size)[3:]:
        out, n = out[: len(out) - n * step] + out[n * step :], 2 * n
        if bit == "1":
            out, n = out[: len(out) - step] + values[n * step :], n + 1
    return out


def _denoised_shades(page: np.ndarray, fall: float, patch: int, search: int) -> np.ndarray:
    """Non-local means of a page of two shades; a weight is exp(-fall) to the number of places where two patches differ.

    So the weights are counted by that number, apart for neighbours of the pixel's own shade and of the other one. A pair of
    pixels counts for both. Weights that are lost beside the pixel's own in double precision aren't counted. Bands lie row
    after row in one line, so that a shift is a single distance in it; what a row's end shares with the next row's start
    lies outside of the page.
    """
    height, width = page.shape
    half, reach = patch // 2, search // 2
    low, high = int(page.min()), int(page.max())
    wide = np.pad(page == high, half + reach, mode="reflect" if min(page.shape) > half + reach else "symmetric").view(np.uint8)
    across = wide.shape[1]
    unlike = int(LEAST_WEIGHT / fall) + 1
    kinds = np.arange(unlike, dtype=np.uint8)[:, None]
    weights = np.exp(-fall * np.arange(unlike))
    shifts = [dy * across + dx for dy in range(reach + 1) for dx in range(-reach, reach + 1) if dy or dx > 0]
    middle, first = half * (across + 1), reach * (across + 1)
    out, step = np.empty_like(page), max(1, BAND // 4 // across)
    for top in range(0, height, step):
        rows = min(step, height - top)
        line = wide[top : top + rows + 2 * (half + reach)].ravel()
        n = len(line) - (patch - 1) * (across + 1)
        # By the upper left corner of the patch: of each number how many, then of each but 0 those of the other shade.
        few, many = np.zeros((2 * unlike - 1, n), np.uint8), np.zeros((2 * unlike - 1, n), np.uint32)
        found = np.empty((2 * unlike - 1, n), bool)
        for k, shift in enumerate(shifts, 1):
            differs = line[: len(line) - shift] ^ line[shift:]
            places = _sums(_sums(differs, patch, across), patch, 1)
            here = found[:, : len(places)]
            np.equal(places, kinds, out=here[:unlike])
            one = here.view(np.uint8)
            np.bitwise_and(one[1:unlike], differs[middle : middle + len(places)], out=one[unlike:])
            few[:, : len(places)] += one
            few[:, shift : shift + len(places)] += one
            if k % 127 == 0 or k == len(shifts):  # a byte holds no more
                many += few
                few[:] = 0
        many[0] += 1
        total, other = np.tensordot(weights, many[:unlike], 1), np.tensordot(weights[1:], many[unlike:], 1)
        share = np.zeros(rows * across)
        inside = slice(first, first + (rows - 1) * across + width)
        share[: inside.stop - first] = (high - low) * other[inside] / total[inside]
        share = share.reshape(rows, across)[:, :width]
        band = page[top : top + rows]
        out[top : top + rows] = np.rint(np.where(band == low, low + share, high - share))
    return out


def _clipped(n: np.ndarray, most: int) -> np.ndarray:
    """Histograms, one in a row, cut off at most; what was above is given to all levels evenly, the rest to levels at even distances."""
    over = np.maximum(n - most, 0).sum(axis=1, keepdims=True)
    n = np.minimum(n, most) + over // 256
    rest, at = over % 256, np.arange(256)
    apart = np.maximum(256 // np.maximum(rest, 1), 1)
    return n + ((at % apart == 0) & (at // apart < rest))


def contrasted(page: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Histograms evened tile by tile, with clipped slopes; between the middles of tiles their levels are blended linearly."""
    height, width = page.shape
    extra = [-size % tiles for size in page.shape]
    wide = np.pad(page, ((0, extra[0]), (0, extra[1])), mode="reflect" if min(page.shape) > max(extra) else "symmetric") if any(extra) else page
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    most = max(int(clip * th * tw / 256), 1)
    counts, step = np.zeros((tiles, tiles * 256), np.int64), max(1, BAND // wide.shape[1])
    column = np.repeat(np.arange(tiles) * 256, tw)
    for i in range(tiles):
        for top in range(i * th, (i + 1) * th, step):
            counts[i] += np.bincount((wide[top : min(top + step, (i + 1) * th)] + column).ravel(), minlength=tiles * 256)
    levels = np.clip(np.rint(np.cumsum(_clipped(counts.reshape(-1, 256), most), axis=1) * (255 / (th * tw))), 0, 255).ravel()

    def between(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / tile - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    out, step = np.empty_like(page), max(1, BAND // width)
    left, right, fx = between(width, tw)
    up, down, fy = (v[:, None] for v in between(height, th))
    for top in range(0, height, step):
        band, a, b, f = (v[top : top + step] for v in (page, up, down, fy))
        level = lambda i, j: levels[(i * tiles + j) * 256 + band]
        upper = level(a, left) * (1 - fx) + level(a, right) * fx
        lower = level(b, left) * (1 - fx) + level(b, right) * fx
        out[top : top + step] = np.clip(np.rint(upper * (1 - f) + lower * f), 0, 255)
    return out


def sharpened(page: np.ndarray) -> np.ndarray:
    """Five times each pixel, less its four neighbours."""
    wide = np.pad(page, 1, mode="reflect" if min(page.shape) > 1 else "edge").astype(np.int64)
    return np.clip(5 * wide[1:-1, 1:-1] - wide[:-2, 1:-1] - wide[2:, 1:-1] - wide[1:-1, :-2] - wide[1:-1, 2:], 0, 255).astype(np.uint8)


def enhanced(page: np.ndarray) -> np.ndarray:
    return sharpened(contrasted(denoised(page)))


def _gaussian(size: int) -> np.ndarray:
    """A window of the spread that is usual for its size, of sum 1."""
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * spread * spread))
    return w / w.sum()


def local_mean(page: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Weighted mean of a window around each pixel, edges repeated: along the rows, then along the columns."""
    weights, half = _gaussian(size), size // 2
    wide = np.pad(page, half, mode="edge").astype(np.float64)
    rows = sum(w * wide[:, k : k + page.shape[1]] for k, w in enumerate(weights))
    return sum(w * rows[k : k + page.shape[0]] for k, w in enumerate(weights))


def binarized(page: np.ndarray, size: int = WINDOW, darker: int = DARKER) -> np.ndarray:
    """White where a pixel isn't darker than its surroundings by so much or more, else black."""
    return np.where(page > np.rint(local_mean(page, size)) - darker, 255, 0).astype(np.uint8)


def clean(pixels: np.ndarray) -> np.ndarray:
    """Border cut off, deskewed, denoised, contrast raised, sharpened; RGB in, grey out."""
    return enhanced(deskewed(cropped(grey(pixels))))


MODES = ("raw", "clean", "binarized")


def variants(pages: DataFrame) -> DataFrame:
    """document_id, page, mode (raw, clean, binarized), image, width, height and error: three rows a page.

    raw is the image as it came. An image that can't be read has no other variants, and its error says so; so has a null one.
    A page is one row's work at a time, so a task holds one page's pixels, and images of SENT bytes and one page at most.
    """

    def rows(made: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(made, columns=["document_id", "page", "mode", "image", "width", "height", "error"])
        return out.astype({"width": "Int32", "height": "Int32"})

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for d, p, content in frame.itertuples(index=False):
                try:
                    pixels = decode(content)
                    better = clean(pixels)
                    made = {m: (encode(x), x.shape[1], x.shape[0], None) for m, x in (("clean", better), ("binarized", binarized(better)))}
                    made["raw"] = (content, pixels.shape[1], pixels.shape[0], None)
                except ValueError as e:
                    made = {m: (None, None, None, str(e)) for m in MODES} | {"raw": (content, None, None, None)}
                held += [(d, p, m, *made[m]) for m in MODES]
                size += 64 + sum(len(made[m][0] or b"") for m in MODES)
                if size > SENT:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return pages.select("document_id", "page", "image").mapInPandas(make, "document_id string, page int, mode string, image binary, width int, height int, error string")
