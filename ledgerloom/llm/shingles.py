"""Sets of word shingles as sorted arrays of 64-bit hashes, and what is derived from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MANY = 100_000
#: Bits of a parity at most.
WIDEST = 4096


class _Words(dict):
    """Hashes of words; emptied when it holds too many, and after each task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _MANY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def forget() -> None:
    _words.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M2
    x = (x ^ x >> np.uint64(27)) * _M3
    return x ^ x >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    """A-Z are lower-cased; words are what lies between the bytes 20 and 09 to 0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``k`` words.

    With fewer than ``k`` words the whole sequence is the one shingle; without words the set is empty.
    """
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * _M1 + h[j : n - size + 1 + j])
    return np.unique(out)


def digest(own: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def exact_sets(texts: Iterable[str | None], k: int) -> list[tuple[np.ndarray, int]]:
    """The set of shingles of each text without hashes, and the number of its words if they are fewer than ``k``, else 0.

    Words are numbered over all texts, and a shingle is the number that its words' numbers make; where that would not
    fit, the shingles' beginnings are numbered first. Sets of full shingles can be compared with each other, those of
    shorter texts with those of as many words.
    """
    number: dict[bytes, int] = {}
    ids = []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    wide, codes, most = len(number) + 1, [x.copy() for x in ids], len(number) + 1
    for j in range(1, k):
        if most * wide >= 1 << 62:
            _, flat = np.unique(np.concatenate(codes), return_inverse=True)
            ends = np.cumsum([len(c) for c in codes])
            codes, most = [flat[e - len(c) : e] for c, e in zip(codes, ends)], len(flat) + 1
        codes = [c[: len(x) - j] * wide + x[j:] if len(x) > j else c for c, x in zip(codes, ids)]
        most *= wide
    return [(np.unique(c), len(x) if len(x) < k else 0) for c, x in zip(codes, ids)]


def alike(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int], num: int, den: int) -> bool:
    """Whether den * |A and B| >= num * |A or B| for two of ``exact_sets``."""
    (x, n), (y, m) = a, b
    if n != m or not len(x) or not len(y) or den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


class Order:
    """An order of all shingles: rare ones by their hash, then known frequent ones, the rarer first.

    Two sets that share ``num / den`` of their union share a shingle among the first
    n - ceil(n * num / den) + 1 of each, whatever the order is. The order decides only how many others share it too.
    """

    def __init__(self, frequent: np.ndarray, num: int, den: int):
        """``frequent``: hashes, from the rarest to the most frequent."""
        by_hash = np.argsort(frequent)
        self.known, self.place, self.listed = frequent[by_hash], by_hash, frequent
        self.num, self.den = num, den

    def first(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set: the rare ones, and the frequent ones."""
        n = len(own)
        few = n - -(-n * self.num // self.den) + 1 if n else 0
        if not len(self.known):
            return own[:few], own[:0]
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        often = self.known[at] == own
        rare = own[~often][:few]
        return rare, self.listed[np.sort(self.place[at[often]])[: few - len(rare)]]


def bitmap(own: np.ndarray) -> bytes:
    """One bit for each token, at its hash modulo the width: a power of two, at least twice the set."""
    width = max(256, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 256
    bits = np.zeros(width, bool)
    bits[(own & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap (u64 words) at a smaller width, as if made at that width."""
    while len(bits) * 64 > width:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def parity(own: np.ndarray) -> bytes:
    """One bit for each remainder of hashes: whether an odd number of tokens has it. Sets with parities that differ in d bits differ by d tokens at least."""
    width = min(max(64, 1 << (len(own) // 2).bit_length()), WIDEST)
    count = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(count & 1 == 1, bitorder="little").tobytes()


class Parities:
    """Parities of many sets, of any widths; two are compared at the smaller width of both."""

    def __init__(self, of: list[bytes]):
        self.width = np.array([len(x) // 8 for x in of], np.int64)
        self.start, self.words = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(of), np.uint64)

    def _at(self, rows: np.ndarray, width: int) -> np.ndarray:
        out, wide = np.empty((len(rows), width), np.uint64), self.width[rows]
        for own in np.unique(wide).tolist():
            some = wide == own
            found = self.words[self.start[rows[some], None] + np.arange(own)]
            out[some] = np.bitwise_xor.reduce(found.reshape(-1, own // width, width), axis=1)
        return out

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits each of i differs from that of j at the same place."""
        least = np.minimum(self.width[i], self.width[j])
        out = np.zeros(len(i), np.int64)
        for width in np.unique(least).tolist():
            some = least == width
            out[some] = np.bitwise_count(self._at(i[some], width) ^ self._at(j[some], width)).sum(axis=1, dtype=np.int64)
        return out
