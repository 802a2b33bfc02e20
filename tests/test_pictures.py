"""Picture kernels against plain loops, planted angles, and the chain over tables with rows that fail."""

import math

import numpy as np
import pytest

from ledgerloom.functions import images as I
from ledgerloom.functions import pictures as P
from ledgerloom.operators import pictures
from ledgerloom.plans.picture_queries import QUERIES
from ledgerloom.sources.pictures import from_vectors

SHAPES = [(9, 12), (16, 16), (5, 7)]


def picture(shape, seed=1):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


def around(i, n):
    """Mirrored without the edge."""
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def half_up(x):
    return min(255, max(0, math.floor(x + 0.5)))


def loops(grey, pixel):
    h, w = grey.shape
    return np.array([[pixel(y, x, lambda a, b: int(grey[around(a, h), around(b, w)])) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("shape", SHAPES)
def test_denoise(shape):
    grey, patch, window, strength = picture(shape) // 16 + 100, 3, 5, 3.0

    def pixel(y, x, at):
        total = weight = 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                d = sum((at(y + a, x + b) - at(y + dy + a, x + dx + b)) ** 2 for a in (-1, 0, 1) for b in (-1, 0, 1))
                k = np.exp(-d / (patch * patch * strength * strength))
                total, weight = total + k * at(y + dy, x + dx), weight + k
        return half_up(total / weight)

    assert (P.denoised(grey, strength, patch, window) == loops(grey, pixel)).all()


@pytest.mark.parametrize("shape", SHAPES)
def test_bilateral(shape):
    grey = picture(shape)

    def pixel(y, x, at):
        total = weight = 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy * dy + dx * dx <= 4:
                    k = np.exp(-(dy * dy + dx * dx) / (2 * 75.0 * 75.0) - float(at(y + dy, x + dx) - at(y, x)) ** 2 / (2 * 75.0 * 75.0))
                    total, weight = total + k * at(y + dy, x + dx), weight + k
        return half_up(total / weight)

    assert (P.bilateral(grey, 5) == loops(grey, pixel)).all()


def gauss(n, s):
    k = [math.exp(-((i - n // 2) ** 2) / (2 * s * s)) for i in range(n)]
    return [x / sum(k) for x in k]


def test_threshold():
    grey, k = picture((16, 20)), gauss(11, 2.0)
    mean = lambda y, x, at: half_up(sum(k[i] * k[j] * at(y + i - 5, x + j - 5) for i in range(11) for j in range(11)))
    assert (P.thresholded(grey) == loops(grey, lambda y, x, at: 255 if at(y, x) > mean(y, x, at) - 2 else 0)).all()


def test_closing():
    mask = np.zeros((9, 9), np.uint8)
    mask[2:7, 2:4] = mask[2:7, 5:7] = 255
    closed = P.closed(mask, 3)
    assert (closed[2:7, 2:7] == 255).all() and (P.closed(mask) == mask).all() and closed.sum() == 25 * 255


def test_ocr_enhance():
    grey = picture((14, 11))
    h, w = grey.shape
    mean = math.floor(grey.mean() + 0.5)
    one = [[max(0, min(255, int(mean + 1.5 * (int(v) - mean)))) for v in row] for row in grey]
    two = [list(r) for r in one]
    for y in range(h):
        for x in range(w):
            edge = y in (0, h - 1) or x in (0, w - 1)
            s = one[y][x] if edge else math.floor((sum(one[y + a][x + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) + 4 * one[y][x]) / 13 + 0.5)
            two[y][x] = max(0, min(255, int(s + 2.0 * (one[y][x] - s))))
    k = gauss(13, 2.0)

    def pixel(y, x, at):
        more = two[y][x] - half_up(sum(k[i] * k[j] * two[around(y + i - 6, h)][around(x + j - 6, w)] for i in range(13) for j in range(13)))
        return two[y][x] if abs(more) <= 3 else max(0, min(255, two[y][x] + int(more * 150 / 100)))

    assert (P.ocr_enhanced(grey) == loops(grey, pixel)).all()


@pytest.mark.parametrize("shape", [(16, 24), (64, 64), (19, 30)])
def test_contrast(shape):
    grey = picture(shape, 3) // 4 + 60
    h, w = shape
    th, tw = -(-h // 8), -(-w // 8)
    maps = {}
    for ty in range(8):
        for tx in range(8):
            n = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    n[grey[around(y, h), around(x, w)]] += 1
            most = max(1, int(3.0 * th * tw / 256))
            over = sum(max(0, c - most) for c in n)
            n = [min(c, most) + over // 256 for c in n]
            for i in range(over % 256):
                n[i * max(1, 256 // (over % 256))] += 1
            maps[ty, tx] = [min(255, math.floor(sum(n[: v + 1]) * (255 / (th * tw)) + 0.5)) for v in range(256)]

    def pixel(y, x, at):
        fy, fx = y / th - 0.5, x / tw - 0.5
        y0, x0 = math.floor(fy), math.floor(fx)
        t, b, le, r = max(0, y0), min(7, y0 + 1), max(0, x0), min(7, x0 + 1)
        a, c, g = fy - y0, fx - x0, at(y, x)
        return half_up((maps[t, le][g] * (1 - c) + maps[t, r][g] * c) * (1 - a) + (maps[b, le][g] * (1 - c) + maps[b, r][g] * c) * a)

    assert (P.equalized(grey) == loops(grey, pixel)).all()


def lines(angle, n=320):
    y, x = np.mgrid[0:n, 0:n]
    a = np.deg2rad(angle)
    return np.where((-(x - n // 2) * np.sin(a) + (y - n // 2) * np.cos(a)) % 24 < 6, 20, 235).astype(np.uint8)


@pytest.mark.parametrize("angle", [-20, -13.5, -5, -2, -1, 0, 1, 2, 3.5, 7, 12, 20])
def test_deskew(angle):
    assert abs(P.skew(lines(angle)) - angle) <= 0.5
    assert abs(P.skew(P.deskewed(lines(angle)))) <= 0.5
    noisy = np.clip(lines(angle) + np.random.default_rng(2).normal(0, 4, (320, 320)), 0, 255).astype(np.uint8)
    assert abs(P.skew(noisy) - angle) <= 0.5


def test_deskew_leaves_what_has_no_lines():
    flat = np.full((80, 80), 7, np.uint8)
    assert P.skew(flat) is None and P.deskewed(flat) is flat
    assert (P.rotated(picture((21, 21)), 90) == np.rot90(picture((21, 21)))).all()
    assert (P.rotated(picture((21, 30)), 0) == picture((21, 30))).all()


def test_edges_are_thin_and_reachable():
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 40
    assert P.edges(step).sum(axis=1).tolist() == [1] * 20  # gradient 160: one pixel across
    weak = np.zeros((20, 20), np.uint8)
    weak[:, 10:] = 20  # gradient 80: above the low bound only
    assert not P.edges(weak).any()
    weak[:5, 10:] = 40
    assert P.edges(weak)[:, 8:12].any(axis=1).all()  # reached from the strong part


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (2, 3), (70, 9)])
def test_odd_sizes(shape):
    for kernel in pictures.STEPS.values():
        assert kernel(picture(shape)).shape == shape


def test_chain_keeps_every_row(spark):
    good = picture((20, 30))
    rows = [(1, good.tobytes(), 30, 20, "x"), (2, None, 30, 20, "x"), (3, b"abc", 30, 20, "x"), (4, b"", 0, 0, "x"), (5, good.tobytes(), None, 20, None)]
    df = spark.createDataFrame(rows, "id int, data binary, width int, height int, quality string")
    got = {r.id: r for r in pictures.preprocessed(df).collect()}
    want = good
    for step in pictures.CHAIN:
        want = pictures.STEPS[step](want)
    assert bytes(got[1].made) == want.tobytes() and got[1].failed_step is None and got[1].quality == "x"
    assert all(got[i].failed_step == "load" and "Could not load" in got[i].step_error for i in (2, 3, 4, 5))
    assert bytes(got[3].made) == b"abc" and got[2].made is None
    broken = pictures.preprocessed(df.where("id = 1"), steps=("sharpen", "denoise"), options={"denoise": {"patch": "no"}}).head()
    assert broken.failed_step == "denoise" and bytes(broken.made) == good.tobytes() and broken.made_width == 30
    with pytest.raises(ValueError, match="unknown steps"):
        pictures.preprocessed(df, steps=("blur",))
    with pytest.raises(ValueError, match="quality"):
        pictures.preprocessed(df, measure=True)
    measured = pictures.preprocessed(df.drop("quality"), steps=(), measure=True).where("id = 1").head()
    assert measured.quality.sharpness == pytest.approx(I.quality(good)["sharpness"]) and measured.quality.total_pixels == 600
    assert pictures.preprocessed(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, kernel", [("img_denoise", P.denoised), ("img_text_mask", P.text_mask), ("img_ocr_enhance", P.ocr_enhanced), ("img_deskew", lambda g: P.deskewed(g, 24))])
def test_queries_without_sql(spark, sf, name, kernel):
    import hashlib

    want = {}
    for r in from_vectors(spark, sf).collect():
        want[r.picture_id] = hashlib.md5(kernel(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)).tobytes().hex().upper().encode()).hexdigest()
    assert {r.picture_id: r.made_md5 for r in QUERIES[name](spark, sf).collect()} == want
    assert want


def test_pictures_are_their_vectors(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    for r in from_vectors(spark, sf).collect():
        ids = sorted(i for i in vectors if i // 64 == r.picture_id)
        assert list(r.data) == [max(0, min(255, math.floor(x * 256) + 128)) for i in ids for x in vectors[i]]


def test_whole_chain_query(spark):
    at = "/root/testdata/sf0.01"
    got = {r.picture_id: r for r in QUERIES["img_preprocess"](spark, at).collect()}
    assert all((r.failed_step == "load") == (i % 5 in (1, 3)) for i, r in got.items()) and len(got) == 8
    assert all(max(r.made_width, r.made_height) == 32 for r in got.values() if r.failed_step is None)
