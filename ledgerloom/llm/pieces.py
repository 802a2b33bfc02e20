"""Splitting of text into the pieces that byte-level BPE encodes one by one, with reuse of results."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

#: Only characters for which ``re`` and ``regex`` agree on letters, digits and white space.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‟€…]*\Z")
_LONG = 120

#: A pattern whose matches follow from the classes of characters alone: ``starts`` finds them for whole batches.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE, _LETTER, _NUMBER, _OTHER, _END = range(5)
#: Ends texts in a batch; UTF-8 has no such byte.
_STOP = b"\xff"


def _plain_form(pattern: str) -> str:
    """The same pattern for ``re``, for texts that ``_PLAIN`` matches."""
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+")
        .replace(r"\p{L}+", r"[^\W\d_]+")
        .replace(r"\p{N}+", r"\d+")
    )


class PieceEncoder:
    """Encodes whole texts by encoding each distinct piece, a match of ``pattern``, once.

    ``encode`` gives the bytes of pieces. Results are kept; the store is emptied when it holds
    ``capacity`` entries and very long pieces are not kept, so memory is bounded.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], capacity: int = 300_000):
        self._full, self._encode, self._capacity = regex.compile(pattern), encode, capacity
        plain = _plain_form(pattern)
        self._fast = None if r"\p" in plain else re.compile(plain)
        self._known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if self._fast and _PLAIN.match(text):
            return self._fast.findall(text)
        return self._full.findall(text)

    def forget(self) -> None:
        self._known.clear()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The encoded bytes of each text."""
        known = self._known
        if len(known) > self._capacity:
            known.clear()
        cut = [self.split(t) for t in texts]
        new = list(set().union(*(set(parts).difference(known) for parts in cut)))
        fresh = dict(zip(new, self._encode(new)))
        long = {p: b for p, b in fresh.items() if len(p) > _LONG}
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for p in long:
            del known[p]
        return out


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points as ``regex`` has them, and of single bytes."""
    every, kinds = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, run in ((_WHITE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(run, every):
            kinds[m.start() : m.end()] = kind
    single = kinds[:256].copy()
    single[_STOP[0]] = _END
    return kinds, single


def starts(data: bytes) -> np.ndarray:
    """Where matches of ``RUNS`` start in UTF-8 texts, each with ``_STOP`` behind it, and one more behind all; stops count as matches."""
    raw, (kinds, single) = np.frombuffer(data, np.uint8), _kinds()
    kind = single[raw]
    wide = np.flatnonzero(raw >= 0xC0)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        own = wide[(raw[wide] >= low) & (raw[wide] < high)]
        point = (raw[own] - low).astype(np.int32)
        for k in range(1, size):
            point = point << 6 | raw[own + k] & 0x3F
        for k in range(size):
            kind[own + k] = kinds[point]
    start = np.append(True, kind[1:] != kind[:-1])
    start[raw == _STOP[0]] = True
    # the last white space before other characters stands alone or, if it is a plain space, goes with them
    word = np.flatnonzero(start[1:] & (kind[:-1] == _WHITE) & (kind[1:] != _END)) + 1
    last = word - 1
    within = np.flatnonzero(raw[last] & 0xC0 == 0x80)
    while len(within):
        last[within] -= 1
        within = within[raw[last[within]] & 0xC0 == 0x80]
    start[last] = True
    start[word[raw[last] == 32]] = False
    quote = np.flatnonzero(raw == 39)
    quote = quote[start[quote]]
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        own = quote[(raw[quote + 1] == ending[0]) & (raw[quote + len(ending)] == ending[-1])]
        start[own + 1] = False
        start[own + 1 + len(ending)] = True
    return np.flatnonzero(start)


class PooledEncoder(PieceEncoder):
    """The same for pieces that are ids, little-endian u32: texts of a call are split, looked up and put together at once.

    Arrow numbers the distinct pieces of a call, so that only those are looked up. Their ids lie in one
    pool, from which those of all texts are gathered. Patterns other than ``RUNS`` go the way of ``PieceEncoder``.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], capacity: int = 300_000):
        super().__init__(pattern, encode, capacity)
        self._runs = pattern == RUNS
        self.forget()

    def forget(self) -> None:
        super().forget()
        self._place, self._pool, self._ends = {_STOP: 0}, np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces in the pool. New ones are added, very long ones behind all that are kept."""
        found = np.fromiter(map(self._place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = sorted(np.flatnonzero(found < 0).tolist(), key=lambda i: len(pieces[i]) > _LONG)
        if new:
            made = self._encode([pieces[i].decode() for i in new])
            found[new] = np.arange(len(new)) + len(self._ends) - 1
            self._place.update((pieces[i], k) for i, k in zip(new, found[new].tolist()) if len(pieces[i]) <= _LONG)
            self._ends = np.append(self._ends, self._ends[-1] + np.cumsum([len(x) // 4 for x in made]))
            self._pool = np.append(self._pool, np.frombuffer(b"".join(made), "<u4"))
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self._runs:
            return super().__call__(texts)
        if len(self._place) > self._capacity:
            self.forget()
        data = _STOP.join([*(t.encode() for t in texts), _STOP])
        at = starts(data)
        cut = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        place = self._places(cut.dictionary.to_numpy(zero_copy_only=False).tolist())[cut.indices.to_numpy()]
        first, n = self._ends[place], np.diff(self._ends)[place]
        end = np.cumsum(n)
        ids = self._pool[np.repeat(first - end + n, n) + np.arange(n.sum())].tobytes()
        kept = len(self._place)
        self._ends, self._pool = self._ends[: kept + 1], self._pool[: self._ends[kept]]
        stops = (4 * end[np.frombuffer(data, np.uint8)[at[:-1]] == _STOP[0]]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]
