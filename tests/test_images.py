"""Image variants against versions that go pixel by pixel."""

import time

import numpy as np
import pytest

from folium.models import images, png


def scan(seed, shape=(24, 30)):
    rng = np.random.default_rng(seed)
    page = np.full(shape, 235, np.int64)
    page[5:9, 4:26] = 40
    page[12:15, 8:20] = 90
    return np.clip(page + rng.integers(-15, 15, shape), 0, 255).astype(np.uint8)


def lines(angle, shape=(400, 320)):
    """A page of dark lines, turned clockwise."""
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    a = np.radians(angle)
    u, v = np.cos(a) * (x - shape[1] / 2) + np.sin(a) * (y - shape[0] / 2), -np.sin(a) * (x - shape[1] / 2) + np.cos(a) * (y - shape[0] / 2)
    ink = (np.abs(u) < 100) & (np.abs(v) < 130) & (np.floor((v + 130) / 10) % 2 == 0)
    return np.where(ink, 20, 255).astype(np.uint8)


def reflected(page, y, x):
    h, w = page.shape
    y, x = (-y if y < 0 else 2 * h - 2 - y if y >= h else y), (-x if x < 0 else 2 * w - 2 - x if x >= w else x)
    return int(page[y, x])


@pytest.mark.parametrize("angle", [-9.5, -4, -0.7, 0.5, 2.25, 7, 9.9])
def test_skew_and_turning(angle):
    page = lines(angle)
    assert images.skew(page) == pytest.approx(angle, abs=0.1)
    upright = images.deskewed(page)
    assert upright.shape == page.shape and abs(images.skew(upright)) <= 0.2
    assert (np.abs(upright.astype(int) - lines(0)) > 128).mean() < 0.03


@pytest.mark.parametrize("page", [lines(0), lines(12), lines(-15), np.full((40, 40), 7, np.uint8)])
def test_pages_that_are_not_turned(page):
    assert images.deskewed(page) is page


def test_few_dark_pixels_are_not_turned():
    page = np.full((200, 200), 255, np.uint8)
    for k in range(45):
        page[100 + k // 12, 20 + 2 * k : 22 + 2 * k] = 0
    assert 0 < (page == 0).sum() < 100 and images.skew(page) == 0


def test_least_rectangle_by_all_edges():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, *[30] * 60]:
        mask = np.zeros((40, 50), bool)
        mask[rng.integers(0, 40, n), rng.integers(0, 50, n)] = True
        corners = images.hull(mask)
        points = np.argwhere(mask)[:, ::-1].astype(float)
        best = None
        for a, b in zip(corners, np.roll(corners, -1, axis=0)):
            t = np.arctan2(*(b - a)[::-1])
            side = (b - a)[0] * (points - a)[:, 1] - (b - a)[1] * (points - a)[:, 0]
            assert (side >= 0).all()  # all pixels on one side: a hull
            u, v = points @ [np.cos(t), np.sin(t)], points @ [-np.sin(t), np.cos(t)]
            best = min(best or np.inf, np.ptp(u) * np.ptp(v)) if len(corners) > 2 else 0
        assert images.least_rectangle(corners)[0] == pytest.approx(best or 0, abs=1e-6)
        assert -45 < images.least_rectangle(corners)[1] <= 45


def test_otsu_by_all_levels():
    page = scan(1)

    def between(t):
        low, high = page[page <= t].astype(float), page[page > t].astype(float)
        return len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else -1

    assert between(images.otsu(page)) == pytest.approx(max(map(between, range(256))))


def test_denoised_pixel_by_pixel(monkeypatch):
    page = scan(2, (14, 17))
    want = np.zeros(page.shape)
    for y in range(14):
        for x in range(17):
            total = weights = 0.0
            for dy in range(-4, 5):
                for dx in range(-4, 5):
                    d = sum((reflected(page, y + a, x + b) - reflected(page, y + dy + a, x + dx + b)) ** 2 for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
                    w = np.exp(-d / 144)
                    total, weights = total + w * reflected(page, y + dy, x + dx), weights + w
            want[y, x] = np.rint(total / weights)
    assert (images.denoised(page, 12, 3, 9) == want).all()
    monkeypatch.setattr(images, "BAND", 40)  # bands of two rows
    assert (images.denoised(page, 12, 3, 9) == want).all()
    noisy = scan(3, (40, 60))
    assert images.denoised(noisy)[20:, :].std() < noisy[20:, :].std() / 2


def test_denoised_pages_of_two_shades(monkeypatch):
    """By definition, whatever the bands; and in less than half of the time that a page of three shades takes."""
    rng = np.random.default_rng(9)
    for shape, low, high in (((12, 15), 0, 255), ((3, 16), 20, 245), ((17, 2), 0, 200), ((9, 9), 100, 110)):
        page = np.where(rng.random(shape) < 0.4, low, high).astype(np.uint8)
        wide = np.pad(page, 5, mode="reflect" if min(shape) > 5 else "symmetric").astype(float)
        patches = np.lib.stride_tricks.sliding_window_view(wide, (3, 3))
        want = np.zeros(shape)
        for y, x in np.ndindex(shape):
            near = patches[y : y + 9, x : x + 9]
            w = np.exp(-((near - patches[y + 4, x + 4]) ** 2).mean(axis=(2, 3)) / 144)
            want[y, x] = np.rint((w * near[:, :, 1, 1]).sum() / w.sum())
        for band in (1 << 18, 4 * 60):
            monkeypatch.setattr(images, "BAND", band)
            assert (images.denoised(page, 12, 3, 9) == want).all()
    monkeypatch.undo()
    page = np.where(lines(2) < 128, 0, 255).astype(np.uint8)
    grey = page.copy()
    grey[0, 0] = 254

    def seconds(p):
        start = time.perf_counter()
        images.denoised(p)
        return time.perf_counter() - start

    assert min(seconds(page) for _ in range(3)) < min(seconds(grey) for _ in range(2)) / 2


def test_contrasted_pixel_by_pixel():
    page = scan(5, (33, 29))
    tiles, th, tw = 8, 5, 4
    levels = {}
    for i in range(tiles):
        for j in range(tiles):
            n = [0] * 256
            for y in range(i * th, (i + 1) * th):
                for x in range(j * tw, (j + 1) * tw):
                    n[reflected(page, y, x)] += 1
            most = max(int(2.0 * th * tw / 256), 1)
            over = sum(max(v - most, 0) for v in n)
            n = [min(v, most) + over // 256 for v in n]
            for k in range(over % 256):
                n[k * max(256 // (over % 256), 1)] += 1
            levels[i, j] = [min(255, round(sum(n[: v + 1]) * 255 / (th * tw))) for v in range(256)]
    got = images.contrasted(page)
    for y in range(33):
        for x in range(29):
            fy, fx = y / th - 0.5, x / tw - 0.5
            i, j = int(np.floor(fy)), int(np.floor(fx))
            at = lambda a, b: levels[min(max(a, 0), 7), min(max(b, 0), 7)][page[y, x]]
            u, v = fy - i, fx - j
            value = (1 - u) * ((1 - v) * at(i, j) + v * at(i, j + 1)) + u * ((1 - v) * at(i + 1, j) + v * at(i + 1, j + 1))
            assert abs(got[y, x] - value) <= 0.5 + 1e-9


def test_sharpened_and_binarized_pixel_by_pixel():
    page = scan(6)
    h, w = page.shape
    sharp, black = images.sharpened(page), images.binarized(page, 7, 5)
    spread = 0.3 * (3 - 1) + 0.8
    weights = np.exp(-(np.arange(-3, 4) ** 2) / (2 * spread**2))
    weights /= weights.sum()
    for y in range(h):
        for x in range(w):
            around = [reflected(page, y + a, x + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
            assert sharp[y, x] == min(255, max(0, 5 * int(page[y, x]) - sum(around)))
            mean = sum(weights[a + 3] * weights[b + 3] * page[min(max(y + a, 0), h - 1), min(max(x + b, 0), w - 1)] for a in range(-3, 4) for b in range(-3, 4))
            assert black[y, x] == (255 if page[y, x] > np.rint(mean) - 5 else 0)


def test_cropped():
    page = np.full((100, 80), 250, np.uint8)
    assert images.cropped(page) is page
    page[30:80, 20:60] = 245
    assert images.cropped(page).shape == (70, 60)
    page[30:80, 20:60] = 246
    page[50, 40] = 0
    assert images.cropped(page) is page  # too little would be left
    page[5, 3] = page[95, 77] = 0
    assert images.cropped(page).shape == (100, 80)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (3, 2), (7, 7)])
def test_tiny_pages(shape):
    page = np.random.default_rng(0).integers(0, 255, (*shape, 3)).astype(np.uint8)
    better = images.clean(page)
    assert better.shape == images.binarized(better).shape == shape


def test_variants(spark):
    page = np.repeat(lines(3, (120, 100))[:, :, None], 3, axis=2)
    rows = spark.createDataFrame([("a", 1, png.encode(page)), ("b", 2, b"none"), ("c", 3, None)], "document_id string, page int, image binary")
    got = {(r.document_id, r.mode): r for r in images.variants(rows).collect()}
    assert len(got) == 9 and bytes(got["a", "raw"].image) == png.encode(page)
    better = images.clean(page)
    assert (png.decode(got["a", "clean"].image)[:, :, 0] == better).all() and (got["a", "clean"].width, got["a", "clean"].height) == better.shape[::-1]
    assert (png.decode(got["a", "binarized"].image)[:, :, 1] == images.binarized(better)).all()
    for d, mode in (("b", "clean"), ("c", "binarized")):
        assert got[d, mode].image is None and got[d, mode].error and got[d, "raw"].error is None


def test_filters_by_diagonals():
    """All filters, mixed line by line, against each pixel's definition; tall, wide and single columns."""
    rng = np.random.default_rng(8)
    for h, w, n in ((1, 1, 1), (9, 1, 3), (1, 9, 3), (13, 6, 2), (6, 13, 4)):
        given, kinds = rng.integers(0, 256, (h, w * n)), rng.integers(0, 5, h)
        kinds[0] = 4
        raw = b"".join(bytes([k]) + bytes(line.tolist()) for k, line in zip(kinds, given))
        want = np.zeros((h, w * n), int)
        for y in range(h):
            for x in range(w * n):
                a, b, c = (want[y, x - n] if x >= n else 0), (want[y - 1, x] if y else 0), (want[y - 1, x - n] if y and x >= n else 0)
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                want[y, x] = (given[y, x] + (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
        assert (png._unfiltered(raw, h, w * n, n) == want).all()
