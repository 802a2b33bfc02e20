"""Kernels that make a picture easier to read: grey picture -> grey picture, as whole-array NumPy operations.

Each is bounded by the picture and its window: memory is a few copies of the picture, whatever the window.
"""

from __future__ import annotations

import numpy as np

# Parameters of the steps.
CLIP, TILES = 3.0, 8
STRENGTH, PATCH, WINDOW = 3.0, 7, 21
LOW, HIGH, VOTES, LEAST_SKEW, MOST_SKEW = 50, 150, 100, 0.5, 45
BILATERAL, SIGMA = 9, 75.0
BLOCK, OFFSET = 11, 2
CONTRAST, SHARPNESS, RADIUS, PERCENT, THRESHOLD = 1.5, 2.0, 2.0, 150, 3


def bytes_of(x: np.ndarray) -> np.ndarray:
    """To the nearest of 0 to 255, halves up."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _padded(x: np.ndarray, by: int, mode: str = "reflect") -> np.ndarray:
    """Borders mirrored without the edge pixel; where a picture is narrower than that, mirrored again."""
    return np.pad(x, by, mode=mode) if min(x.shape) > 1 or mode == "edge" else np.pad(x, by, mode="edge")


def convolved(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A separable filter of odd length, borders mirrored."""
    h, w = x.shape
    r = len(rows) // 2
    p = _padded(x.astype(float), r)
    p = sum(k * p[i : i + h] for i, k in enumerate(rows))
    return sum(k * p[:, j : j + w] for j, k in enumerate(columns))


def gaussian(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def equalized(grey: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast limited adaptive histogram equalisation.

    Histograms of ``tiles`` by ``tiles`` tiles are cut at ``clip`` times their mean, what was cut is dealt to all values, remainders at even
    distances. A pixel is mapped by the four tiles whose centres are around it, blended by distance.
    """
    h, w = grey.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "symmetric")
    cells = full.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, th * tw).astype(np.int64)
    area = th * tw
    counts = np.bincount((cells + 256 * np.arange(tiles * tiles)[:, None]).ravel(), minlength=256 * tiles * tiles).reshape(-1, 256)
    most = max(1, int(clip * area / 256))
    over = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    left = over % 256
    for cell in np.flatnonzero(left):
        step = max(1, 256 // left[cell])
        counts[cell, np.arange(0, 256, step)[: left[cell]]] += 1
    maps = np.clip(np.floor(np.cumsum(counts, axis=1) * (255 / area) + 0.5), 0, 255).reshape(tiles, tiles, 256)

    def near(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (t, b, fy), (le, r, fx) = near(h, th), near(w, tw)
    at = lambda y, x: maps[y[:, None], x[None, :], grey]
    fy, fx = fy[:, None], fx[None, :]
    return bytes_of((at(t, le) * (1 - fx) + at(t, r) * fx) * (1 - fy) + (at(b, le) * (1 - fx) + at(b, r) * fx) * fy)


def _box_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over n by n cells, by a summed-area table."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    s[1:, 1:] = x.cumsum(axis=0).cumsum(axis=1)
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def denoised(grey: np.ndarray, strength: float = STRENGTH, patch: int = PATCH, window: int = WINDOW) -> np.ndarray:
    """Non-local means: each pixel the mean of the window around it, by the likeness of the patches around both.

    Squared differences of the picture and its shift become sums over patches by one summed-area table for each shift, so the cost is that of the window, not of window times patch.
    """
    h, w = grey.shape
    p, r = patch // 2, window // 2
    x = _padded(grey.astype(np.int64), p + r)
    own = x[r : r + h + 2 * p, r : r + w + 2 * p]
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(window):
        for dx in range(window):
            d = own - x[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
            like = np.exp(-_box_sums(d * d, patch) / (patch * patch * strength * strength))
            total += like * x[dy + p : dy + p + h, dx + p : dx + p + w]
            weight += like
    return bytes_of(total / weight)


def edges(grey: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Edge pixels: gradient above ``high``, or above ``low`` and reachable from such over neighbours; the largest across the edge only."""
    smooth, slope = np.array([1, 2, 1]), np.array([-1, 0, 1])
    gx, gy = convolved(grey, smooth, slope), convolved(grey, slope, smooth)
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    h, w = m.shape
    at = lambda dy, dx: q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    steep = np.abs(gy) > np.tan(np.pi * 3 / 8) * np.abs(gx)
    flat = np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx)
    falls = (gx * gy) > 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(falls, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(falls, at(1, 1), at(1, -1))))
    thin = (m > before) & (m >= after) & (m > low)
    found = thin & (m > high)
    while True:
        p = np.pad(found, 1)
        grown = thin & np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        if (grown == found).all():
            return found
        found = grown


def skew(grey: np.ndarray, votes: int = VOTES) -> float | None:
    """Median angle in degrees of the straight lines with more than ``votes`` edge pixels, None without any.

    Lines are peaks among votes for (distance from the corner, direction of the normal in whole degrees); a direction past 45 degrees counts from the
    vertical, so lines of text count by their slope.
    """
    y, x = np.nonzero(edges(grey))
    if not len(y):
        return None
    theta = np.deg2rad(np.arange(180))
    reach = int(np.hypot(*grey.shape)) + 1
    rho = np.rint(x[:, None] * np.cos(theta) + y[:, None] * np.sin(theta)).astype(int) + reach
    n = np.zeros((182, 2 * reach + 3), np.int64)  # a border of no votes
    n[1:-1, 1:-1] = np.bincount((rho + np.arange(180) * (2 * reach + 1)).ravel(), minlength=180 * (2 * reach + 1)).reshape(180, -1)
    mid = n[1:-1, 1:-1]
    peak = (mid > votes) & (mid > n[1:-1, :-2]) & (mid >= n[1:-1, 2:]) & (mid > n[:-2, 1:-1]) & (mid >= n[2:, 1:-1])
    angle = np.nonzero(peak)[0].astype(float)
    angle = np.where(angle > 45, angle - 90, angle)
    angle = angle[np.abs(angle) < MOST_SKEW]
    return float(np.median(angle)) if len(angle) else None


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    """Weights of four neighbours of a place ``t`` past the second."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def rotated(grey: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the middle, by cubic interpolation; beyond the border its pixels go on."""
    h, w = grey.shape
    cy, cx, a = h // 2, w // 2, np.deg2rad(degrees)
    dy, dx = np.arange(h)[:, None] - cy, np.arange(w)[None, :] - cx
    sx, sy = np.cos(a) * dx - np.sin(a) * dy + cx, np.sin(a) * dx + np.cos(a) * dy + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy, out = _cubic(sx - x0), _cubic(sy - y0), np.zeros((h, w))
    for i in range(4):
        row = np.clip(y0 + i - 1, 0, h - 1)
        out += wy[i] * sum(wx[j] * grey[row, np.clip(x0 + j - 1, 0, w - 1)] for j in range(4))
    return bytes_of(out)


def deskewed(grey: np.ndarray, votes: int = VOTES) -> np.ndarray:
    angle = skew(grey, votes)
    return grey if angle is None or abs(angle) <= LEAST_SKEW else rotated(grey, angle)


def bilateral(grey: np.ndarray, diameter: int = BILATERAL, sigma: float = SIGMA) -> np.ndarray:
    """Mean of the disk around a pixel, by nearness in place and in value, so edges stay."""
    h, w = grey.shape
    r = diameter // 2
    p, x = _padded(grey.astype(float), r), grey.astype(float)
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                y = p[r + dy : r + dy + h, r + dx : r + dx + w]
                k = np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma) - (y - x) ** 2 / (2 * sigma * sigma))
                total += k * y
                weight += k
    return bytes_of(total / weight)


def thresholded(grey: np.ndarray, block: int = BLOCK, offset: int = OFFSET) -> np.ndarray:
    """White where a pixel is above the Gaussian mean around it less ``offset``."""
    k = gaussian(0.3 * ((block - 1) * 0.5 - 1) + 0.8, block // 2)
    return np.where(grey > bytes_of(convolved(grey, k, k)).astype(int) - offset, 255, 0).astype(np.uint8)


def closed(mask: np.ndarray, side: int = 1) -> np.ndarray:
    """The largest, then the smallest around each pixel: gaps narrower than ``side`` close. A side of 1 changes nothing."""
    h, w = mask.shape
    for best in (np.maximum, np.minimum):
        p = _padded(mask, side // 2, "edge")
        mask = best.reduce([p[i : i + h, j : j + w] for i in range(side) for j in range(side)])
    return mask


def text_mask(grey: np.ndarray) -> np.ndarray:
    return closed(thresholded(bilateral(grey)))


def ocr_enhanced(grey: np.ndarray) -> np.ndarray:
    """Contrast about the whole mean, sharpness by extrapolating from a smoothed picture, then an unsharp mask where it differs enough."""
    mean = np.floor(grey.mean() + 0.5)
    x = np.clip(np.trunc(mean + CONTRAST * (grey - mean)), 0, 255)
    smooth = x.copy()
    if min(x.shape) > 2:
        around = sum(x[i : i + x.shape[0] - 2, j : j + x.shape[1] - 2] for i in range(3) for j in range(3))
        smooth[1:-1, 1:-1] = np.floor((around + 4 * x[1:-1, 1:-1]) / 13 + 0.5)
    x = np.clip(np.trunc(smooth + SHARPNESS * (x - smooth)), 0, 255)
    k = gaussian(RADIUS, 3 * int(np.ceil(RADIUS)))
    more = x - bytes_of(convolved(x, k, k)).astype(int)
    return np.clip(np.where(np.abs(more) > THRESHOLD, x + np.trunc(more * PERCENT / 100), x), 0, 255).astype(np.uint8)
