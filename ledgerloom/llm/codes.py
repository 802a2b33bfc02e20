"""Product quantisation of vectors in whole numbers: the same codes on any machine and in any order of rows.

Components become floor(4096 * x). Vectors are cut into parts of equal width, each part has a codebook of up to 16
entries. Distances are screened by float32 matrix products: each product comes with a bound on its rounding error,
so each squared distance is known to lie in an interval. Entries whose interval reaches below the lowest upper end
are compared again in int64, ties go to the lower index; a lone one has won. So a result never depends on
rounding. Rounds exchange sums for each entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest magnitude of a scaled component; what is beyond counts as it.
MOST = 1 << 62
#: From this magnitude on squares may not fit in int64, and Python's own numbers take their place.
_WIDE = 1 << 27
_STEP = 4096
_UNIT = 2.0**-24  # of float32


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64; a product with a power of two is exact, so the floor is, too."""
    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    return np.where(np.abs(y) < MOST, y, 0).astype(np.int64) + np.where(y >= MOST, MOST, 0) - np.where(y <= -MOST, MOST, 0)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows; Python's numbers where int64 might overflow."""
    wide = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) >= _WIDE or x.shape[-1] >= 128
    d = x.astype(object) - y.astype(object) if wide else x - y
    return (d * d).sum(axis=-1)


def _screened(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest: (rows, entries) booleans, at least one true in each row."""
    width, a, b = x.shape[1], x.astype(np.float64), book.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
        # |x . c| errs by at most gamma * sum |x_i c_i|, and that sum is at most |x| |c|; two more roundings turn both
        # into float32, one per product, one per sum; the rest of float64's own rounding is far below the factor 1.01
        gamma = (width + 3) * _UNIT / (1 - (width + 3) * _UNIT)
        norms = np.sqrt((b * b).sum(axis=1))
        error = 1.01 * 2 * gamma * np.sqrt((a * a).sum(axis=1))[:, None] * norms + (norms * norms) * 1e-12 + 1e-6
        score = norms * norms - 2 * product  # the squared distance but for |x|^2, the same for all entries
        low, high = score - error, score + error
    known = np.isfinite(low) & np.isfinite(high)
    low, high = np.where(known, low, -np.inf), np.where(known, high, np.inf)
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry for each row, the lower one of a tie, exactly."""
    may = _screened(x, book)
    best = may.argmax(axis=1)
    open_ = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_):
        r, e = np.nonzero(may[open_])
        d = _exact(x[open_[r]], book[e])
        order = np.lexsort((e, d, r)) if d.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], d[i], e[i])))
        first = np.r_[True, np.diff(r[order]) > 0]
        best[open_] = e[order][first]
    return best


def _usable(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists (-1 for null ones and those with null or non-finite numbers) and all their numbers."""
    starts = np.asarray(column.offsets)
    values = column.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]  # nulls are NaN
    lengths = np.where((bad[starts[1:]] > bad[starts[:-1]]) | ~column.is_valid().to_numpy(zero_copy_only=False), -1, np.diff(starts))
    return lengths, numbers


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, which are encoded, their numbers scaled) of bounded steps."""
    for whole in batches:
        for at in range(0, whole.num_rows, _STEP):
            batch = whole.slice(at, _STEP)
            lengths, numbers = _usable(batch.column("v"))
            fit = lengths == width
            starts = np.asarray(batch.column("v").offsets)[:-1]
            rows = (starts - starts[0])[fit][:, None] + np.arange(width) if width else np.zeros((int(fit.sum()), 0), int)
            yield batch.filter(pa.array(lengths >= 0)), fit[lengths >= 0], scaled(numbers[rows])


class Codebooks:
    """``books[p]`` is (entries, width of a part) whole numbers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def parts(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for p, (part, book) in enumerate(zip(np.split(x, len(self.books), axis=1), self.books)):
            yield p, part, nearest(part, book)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(n)) for book in self.books for entry in book for n in entry).encode()).hexdigest()


def _seeds(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Width and scaled vectors of the ENTRIES smallest ids; rows of one id in the order of their numbers."""
    held = rows.where("id IS NOT NULL").orderBy("id", F.col("v").cast("array<double>")).limit(ENTRIES).select("v").collect()  # ENTRIES vectors
    width = len(held[0].v) if held else 0
    same = [h.v for h in held if len(h.v) == width]
    return width, scaled(np.array(same, np.float64).reshape(len(same), width))


def _round(rows: DataFrame, width: int, books: Codebooks) -> Codebooks:
    """Entries become the floor of the mean of their parts. PARTS * ENTRIES sums reach the driver, of two halves so that none overflows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, *b.shape), np.int64) for b in books.books]
        count = [np.zeros(len(b), np.int64) for b in books.books]
        out = []

        def flush() -> None:
            for p, (t, n) in enumerate(zip(total, count)):
                out.extend((p, e, int(n[e]), t[0, e].tolist(), t[1, e].tolist()) for e in np.flatnonzero(n).tolist())
                t[:] = 0
                n[:] = 0

        since = 0
        for _, fit, x in _matrices(batches, width):
            for p, part, best in books.parts(x):
                np.add.at(total[p][0], best, part >> 31)
                np.add.at(total[p][1], best, part & (1 << 31) - 1)
                count[p] += np.bincount(best, minlength=len(count[p]))
            since += len(x)
            if since >= 1 << 30:
                flush()
                since = 0
        flush()
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["p", "e", "n", "high", "low"])

    per = width // len(books.books)
    found = rows.mapInArrow(sums, "p int, e int, n long, high array<long>, low array<long>")
    whole = lambda c: F.array(*(F.sum(F.get(c, F.lit(i)).cast("decimal(38,0)")) for i in range(per))).alias(c)
    new = [b.copy() for b in books.books]
    for r in found.groupBy("p", "e").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect():
        new[r.p][r.e] = [((int(h) << 31) + int(lo)) // r.n for h, lo in zip(r.high, r.low)]
    return Codebooks(new)


def encode(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Returns (``id_col``, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    Rows whose vector is null or holds null or non-finite numbers are dropped. All vectors have the width of the one with
    the smallest id, a multiple of PARTS; of another width, a vector has no code and no error. Rows of equal ids
    are encoded each, those without an id as well, but they start no codebook. Components beyond 2^62 when scaled count as 2^62, errors
    beyond 2^63 - 1 as that. ``label_error`` is the sum over rows of the same label, null labels together, null if none
    of them has an error. With fewer than ENTRIES rows codebooks have as many entries. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    width, seeds = _seeds(named.where(F.col("v").isNotNull() & finite))
    fits = width > 0 and width % PARTS == 0
    books = Codebooks([p.copy() for p in np.split(seeds, PARTS, axis=1)]) if fits else Codebooks([])
    for _ in range(ROUNDS if fits else 0):
        books = _round(named.select("v"), width, books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, fit, x in _matrices(batches, width):
            code, error = [None] * kept.num_rows, [None] * kept.num_rows
            if fits and len(x):
                index, off = [], 0
                for p, part, best in books.parts(x):
                    index.append(best.astype(np.uint8))
                    off = off + _exact(part, books.books[p][best])
                for at, c, e in zip(np.flatnonzero(fit).tolist(), np.stack(index, axis=1), off.tolist()):
                    code[at], error[at] = c.tobytes().hex(), min(e, (1 << 63) - 1)
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    label = df.schema[label_col].dataType.simpleString()
    coded = stored(named.mapInArrow(codes, f"id long, label {label}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    most = F.when(F.col("sum").isNotNull(), F.least("sum", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long"))
    full = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return full.select(F.col("id").alias(id_col), "code", "error", most.alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))
