"""Simple-8b: unsigned integers in 64-bit words, with chunk offsets for decoding a part at once.

A word has a selector in its upper 4 bits and that selector's count of equally wide values in the
lower 60, the first value lowest. Selector 0 is the escape: the next word is one value as it is. A
block is ``S8B1``, the number of chunks (u32), the number of values (u64), the word offset of each
chunk and of the end (u32), then the words, all little-endian. Chunks hold ``CHUNK`` values each.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, CHUNK = b"S8B1", 16384
#: Fixed values of the format: selector, values in a word, bits of a value.
SELECTORS = [(1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]
_COUNT = np.array([1] + [c for _, c, _ in SELECTORS], np.int64)


def _pack_chunk(values: np.ndarray) -> np.ndarray:
    n, top = len(values), int(values.max())
    small = values.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    most, over = np.append(small, np.zeros(128, small.dtype)), 1  # the most of so many values from each on
    chosen = np.zeros(n, np.int8)
    for s, c, bits in reversed(SELECTORS):
        while over < c:
            more = min(over, c - over)
            most = np.maximum(most[:-more], most[more:])
            over += more
        fits = most[:n] < small.dtype.type(1 << bits) if top >= 1 << bits else np.ones(n, bool)
        if not fits.any():
            break  # nor do more of smaller values
        np.copyto(chosen, np.int8(s), where=fits)
    starts, at, step = [], 0, _COUNT[chosen].tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, np.int64)
    selector = chosen[start]
    place = np.cumsum(1 + (selector == 0)) - 1
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    padded = np.concatenate((values, np.zeros(128, np.uint64)))
    escaped = selector == 0
    words[place[escaped]] = values[start[escaped]]
    for s, c, bits in SELECTORS:
        own = selector == s
        if own.any():
            within = np.arange(c)
            parts = padded[start[own][:, None] + within] << (within * bits).astype(np.uint64)
            words[place[own]] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(s << 60)
    return words


def _unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw, last = np.zeros(len(words), bool), -1
    for at in np.flatnonzero(selector == 0).tolist():
        if at != last:
            last = at + 1
            raw[last] = True
    head = ~raw
    escape = np.flatnonzero(head & (selector == 0))
    size = np.where(head, _COUNT[selector], 0)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + 1, np.uint64)
    out[start[escape]] = words[escape + 1]
    for s, c, bits in SELECTORS:
        own = np.flatnonzero(head & (selector == s))
        if len(own) and bits:
            within = np.arange(c)
            out[start[own][:, None] + within] = words[own][:, None] >> (within * bits).astype(np.uint64) & np.uint64((1 << bits) - 1)
    return out[:n]


def pack(values: np.ndarray) -> bytes:
    """A block of any unsigned 64-bit values."""
    values = np.asarray(values).astype(np.uint64)
    parts = [_pack_chunk(values[i : i + CHUNK]) for i in range(0, len(values), CHUNK)]
    offsets = np.cumsum([0, *map(len, parts)])
    head = MAGIC + struct.pack("<IQ", len(parts), len(values)) + offsets.astype("<u4").tobytes()
    return head + b"".join(p.astype("<u8").tobytes() for p in parts)


def unpack(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop`` of a block; only the chunks that hold them are decoded."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    chunks, n = struct.unpack_from("<IQ", block, 4)
    offsets = np.frombuffer(block, "<u4", chunks + 1, 16)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    first, last = start // CHUNK, (stop - 1) // CHUNK
    parts = []
    for k in range(first, last + 1):
        words = np.frombuffer(block, "<u8", int(offsets[k + 1] - offsets[k]), 16 + 4 * (chunks + 1) + 8 * int(offsets[k]))
        parts.append(_unpack_words(words, min(CHUNK, n - k * CHUNK)))
    return np.concatenate(parts)[start - first * CHUNK : stop - first * CHUNK]
