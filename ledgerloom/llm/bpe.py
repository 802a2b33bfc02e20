"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged by itself. A segment tree over the byte positions of the
match holds, in every node, the smallest (rank, position) of the pairs that start below it, so its
root is the leftmost pair of minimum rank. A merge changes three leaves: the pair that starts at the
merged part, the pair before it and the pair that is gone. Each is one update along a path to
the root, so a match of n bytes takes O(n log n), also when it is very long.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .pieces import PieceEncoder
from .shared import ship, tidy

_NONE = 1 << 62
_MASK = (1 << 32) - 1
#: Rows and bytes of one Arrow batch that are worked on together; bounds what is held besides the batch.
_STEP, _STEP_BYTES = 1024, 2 << 20


def steps(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and, but for single long rows, bytes of a column."""
    import pyarrow.compute as pc

    done, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        base = done[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(done, base + _STEP_BYTES, "right"))), at + _STEP)
        yield batch.slice(at, to - at)
        at = to


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by merging the leftmost pair of the lowest rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    rank = ranks.get
    width = 1 << (n - 1).bit_length()
    leaves = [_NONE] * width
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            leaves[i] = r << 32 | i
    levels = [leaves]
    while len(leaves) > 1:
        leaves = list(map(min, leaves[::2], leaves[1::2]))
        levels.append(leaves)
    levels.reverse()
    tree = [0]
    for level in levels:
        tree += level
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (least := tree[1]) != _NONE:
        i = least & _MASK
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        h = before[i]
        # the pair at j is gone, the one at i ends later, and so does the one before it
        r = rank(piece[i : after[k]]) if k < n else None
        changes = [(j, _NONE), (i, _NONE if r is None else r << 32 | i)]
        if h >= 0:
            r = rank(piece[h:k])
            changes.append((h, _NONE if r is None else r << 32 | h))
        for at, value in changes:
            at += width
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class ShortPieces:
    """The same trees for many short pieces side by side, in NumPy.

    Row r of ``tree`` is the segment tree of piece r; position 0 and the position after the last
    byte are sentinels, whose pairs have no rank. In each round every unfinished row makes one merge.
    """

    LONGEST = 62

    def __init__(self, ranks: dict[bytes, int]):
        self.none, self.end = 1 << 30, max(ranks.values(), default=0) + 1
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)
        self.keys = np.append(self.keys, np.int64(1 << 62))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.rank[i] << 6 | at, self.none)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for width in (8, 16, 32, 64):
            own = np.flatnonzero((size + 2 <= width) & (size + 2 > (width // 2 if width > 8 else 0)))
            if len(own):
                for i, x in zip(own.tolist(), self._merge([pieces[i] for i in own.tolist()], size[own], width)):
                    out[i] = x
        return out

    def _merge(self, pieces: list[bytes], n: np.ndarray, width: int) -> list[bytes]:
        m, place = len(pieces), np.arange(width)
        raw = np.frombuffer(b"".join(p.ljust(width - 1, b"\0") for p in pieces), np.uint8).reshape(m, width - 1)
        ids = np.full((m, width), self.end, np.int64)
        alive = (place >= 1) & (place <= n[:, None])
        ids[:, 1:][alive[:, 1:]] = self.byte[raw[alive[:, 1:]]]
        tree = np.full((m, 2 * width), self.none, np.int64)
        tree[:, width:-1] = self._pair(ids[:, :-1], ids[:, 1:], place[:-1])
        for low in (width >> k for k in range(1, width.bit_length())):
            tree[:, low : 2 * low] = tree[:, 2 * low : 4 * low].reshape(m, low, 2).min(axis=2)
        tree, ids, alive = tree.ravel(), ids.ravel(), alive.ravel()
        after = np.tile(np.minimum(place + 1, width - 1), m)
        before = np.tile(np.maximum(place - 1, 0), m)
        row = np.arange(m)
        while len(row := row[(top := tree[row * (2 * width) + 1]) < self.none]):
            top = top[top < self.none]
            at, base = row * width, row * (2 * width)
            i = top & 63
            j = after[at + i]
            k = after[at + j]
            h = before[at + i]
            after[at + i], before[at + k] = k, i
            ids[at + i], alive[at + j] = top >> 6, False
            tree[base + width + j] = self.none
            tree[base + width + i] = self._pair(ids[at + i], ids[at + k], i)
            tree[base + width + h] = self._pair(ids[at + h], ids[at + i], h)
            base3, node = np.concatenate((base, base, base)), np.concatenate((i, j, h)) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                left = base3 + 2 * node
                tree[base3 + node] = np.minimum(tree[left], tree[left + 1])
        data = ids[alive].astype("<u4").tobytes()
        end = np.cumsum(alive.reshape(m, width).sum(axis=1)) * 4
        return [data[a:b] for a, b in zip([0, *end.tolist()], end.tolist())]


def _encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    """One for each worker process, kept for its later tasks."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        ranks = load_ranks(ranks_path)
        short = ShortPieces(ranks)

        def encode(pieces: list[str]) -> list[bytes]:
            raw = [p.encode() for p in pieces]
            out = short([p if len(p) <= short.LONGEST else b"" for p in raw])
            for i, p in enumerate(raw):
                if len(p) > short.LONGEST:
                    ids = merge(p, ranks)
                    out[i] = struct.pack(f"<{len(ids)}I", *ids)
            return out

        _encoders[key] = PieceEncoder(pattern, encode)
    return _encoders[key]


def _tokens(ranks_path: str) -> list[bytes]:
    if ranks_path not in _decoders:
        ranks = load_ranks(ranks_path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        _decoders[ranks_path] = table
    return _decoders[ranks_path]


_encoders: dict[tuple[str, str], PieceEncoder] = {}
_decoders: dict[str, list[bytes]] = {}


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    make = _encoder(ranks_path, pattern)
    try:
        for batch in batches:
            for part in steps(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(make(part.column(1).to_pylist()), pa.binary())], ["id", "ids"])
    finally:
        make.forget()
        tidy()


def _decoded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    get = _tokens(ranks_path).__getitem__
    for batch in batches:
        for part in steps(batch, 1):
            text = [b"".join(map(get, np.frombuffer(x.as_buffer(), "<u4").tolist())) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.binary())], ["id", "ids", "decoded"])


def _mapped(df: DataFrame, id_col: str, rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *names: str) -> DataFrame:
    ship(df.sparkSession)
    out = StructType().add("id", rows.schema["id"].dataType)
    for name in names:
        out = out.add(name, BinaryType())
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Returns (``id_col``, ids BINARY): little-endian unsigned 32-bit ids of each whole text.

    Null and empty texts give empty ids; repeated rows give repeated rows; other columns are left
    out, whatever their names. A row with a null id is kept. The work is row by row: no shuffle,
    and a lost executor repeats only its own tasks.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _mapped(df, id_col, rows, lambda batches: _encoded(batches, ranks_path, pattern), "ids")


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str) -> DataFrame:
    """Returns (``id_col``, ids BINARY, decoded BINARY): the bytes that the ids stand for.

    Null ids give empty bytes. Bytes, not text: cut ids need not end at a character.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _mapped(df, id_col, rows, lambda batches: _decoded(batches, ranks_path), "ids", "decoded")


def round_trip(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task has one Python worker in place of two, and ids travel once."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _mapped(df, id_col, rows, lambda batches: _decoded(_encoded(batches, ranks_path, pattern), ranks_path), "ids", "decoded")


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
