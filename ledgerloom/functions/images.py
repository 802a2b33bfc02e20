"""Kernels on grey pictures as NumPy arrays, and the pandas UDFs that apply them to raw bytes.

Pictures are given as raw 8-bit grey values with width and height; decoding of image files is up to a
plug-in, since no imaging library is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUALITY = "struct<width:int,height:int,total_pixels:int,sharpness:double,brightness:double,contrast:double,noise_level:double,aspect_ratio:double>"


def laplacian(grey: np.ndarray) -> np.ndarray:
    p = np.pad(grey.astype(float), 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def shrink(grey: np.ndarray, side: int = 2048) -> np.ndarray:
    """The longest side at most ``side``, each pixel the mean of the area that it covers."""
    h, w = grey.shape
    scale = min(1.0, side / max(h, w))
    return grey if scale == 1 else resize(grey, max(1, int(h * scale)), max(1, int(w * scale)))


def _areas(n: int, m: int) -> np.ndarray:
    """Weights of n cells in m cells of equal total length."""
    edge = np.arange(m + 1) * n / m
    cell = np.arange(n)
    overlap = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    return np.clip(overlap, 0, None) / (n / m)


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    return _areas(grey.shape[0], height) @ grey.astype(float) @ _areas(grey.shape[1], width).T


def sharpen(grey: np.ndarray) -> np.ndarray:
    """Centre 9, neighbours -1."""
    p = np.pad(grey.astype(float), 1, mode="reflect")
    around = sum(p[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(3) for j in range(3)) - grey
    return np.clip(9.0 * grey - around, 0, 255).astype(np.uint8)


def stretch(grey: np.ndarray, factor: float = 1.5) -> np.ndarray:
    """Contrast about the mean."""
    return np.clip((grey.astype(float) - grey.mean()) * factor + grey.mean(), 0, 255).astype(np.uint8)


def quality(grey: np.ndarray) -> dict[str, float]:
    h, w = grey.shape
    sharp = float(laplacian(grey).var())
    return {"width": w, "height": h, "total_pixels": w * h, "sharpness": sharp, "brightness": float(grey.mean()), "contrast": float(grey.std()), "noise_level": sharp, "aspect_ratio": w / h}


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big", signed=True)


def phash(grey: np.ndarray) -> int:
    """The 8 by 8 lowest frequencies of 32 by 32 pixels: bits over their median."""
    c = _cosines(32)
    low = (c @ resize(grey, 32, 32) @ c.T)[:8, :8]
    return _packed(low > np.median(low))


def dhash(grey: np.ndarray) -> int:
    """Bits where a pixel of 8 by 9 is less than its right neighbour."""
    small = resize(grey, 8, 9)
    return _packed(small[:, 1:] > small[:, :-1])


def whash(grey: np.ndarray) -> int:
    """16 by 16 pixels less their blur, at 8 by 8: bits over the median."""
    small = resize(grey, 16, 16)
    p = np.pad(small, 1, mode="reflect")
    blur = sum(p[i : i + 16, j : j + 16] * k for (i, j), k in np.ndenumerate(np.outer([1, 2, 1], [1, 2, 1]) / 16))
    detail = resize(small - blur, 8, 8)
    return _packed(detail > np.median(detail))


HASHES = {"phash": phash, "dhash": dhash, "whash": whash}


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """min(1, PSNR / 50), squares taken modulo 256 as 8-bit arithmetic gives them."""
    d = a.astype(np.int64) - b.astype(np.int64)
    mse = float((d * d % 256).mean())
    return 1.0 if mse == 0 else float(min(1.0, max(0.0, 20 * np.log10(255 / np.sqrt(mse)) / 50)))


def _grey(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width)


def _fits(data: bytes | None, width: int | None, height: int | None) -> bool:
    return data is not None and bool(width) and bool(height) and width > 0 and height > 0 and len(data) == width * height


def hash_of(kind: str, grey: np.ndarray) -> int | None:
    """The hash by its name, None for a name that there isn't."""
    return HASHES[kind](grey) if kind in HASHES else None


def hash_column(data: Column, width: Column, height: Column, kind: str = "phash") -> Column:
    """BIGINT hash of raw grey pictures, null where the bytes don't fit or there is no such hash."""

    @F.pandas_udf("bigint")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, w, h in parts:
            yield pd.Series([hash_of(kind, _grey(x, int(i), int(j))) if x is not None and i == i and j == j and _fits(x, i, j) else None for x, i, j in zip(d, w, h)], dtype="Int64")

    return run(data, width, height) if kind in HASHES else F.lit(None).cast("bigint")


def quality_column(data: Column, width: Column, height: Column) -> Column:
    """Measures of raw grey pictures, all null where the bytes don't fit."""

    @F.pandas_udf(QUALITY)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        none = dict.fromkeys(quality(np.zeros((1, 1), np.uint8)))
        for d, w, h in parts:
            rows = [quality(_grey(x, int(i), int(j))) if x is not None and i == i and j == j and _fits(x, i, j) else none for x, i, j in zip(d, w, h)]
            whole = {"width": "Int32", "height": "Int32", "total_pixels": "Int32"}
            yield pd.DataFrame(rows, columns=list(none)).astype(whole)

    return run(data, width, height)
