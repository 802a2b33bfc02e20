"""Token-id files: documents' ids in id order, packed by Simple-8b.

A token file set is a folder with two Parquet tables, written and read by Spark alone, so that it can
lie in any store and a lost executor only repeats its own tasks:

``blocks``  bucket, block, token ids in earlier blocks of the bucket, ids of the documents, their lengths and their token ids (Simple-8b blocks)
``index``   bucket, base: token ids in all earlier buckets

Buckets are ranges of document ids, so the order is global: bucket, then block, then place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .bpe import steps
from .pieces import PieceEncoder, PooledEncoder
from .shared import ship
from .simple8b import pack, unpack

#: A block is closed when it holds that many token ids; a longer document makes a larger block.
BLOCK_IDS = 1 << 18
_BLOCKS = "bucket int, block int, ahead long, n_tokens long, ids array<long>, lengths binary, tokens binary"
_SPACE, _LINE_ENDS = re.compile(r"\s"), "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"

#: The characters that byte-level models write bytes as.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
#: Between pieces that are brought into these characters together.
_SEPARATOR = "\uffff"
_SHOWN_SEPARATOR = _SEPARATOR.encode().decode("latin-1").translate(_BYTE_CHARS)

_library: dict[tuple[str, str, bool], Callable[[list[str]], list[bytes]]] = {}


def _with_added(pieces: PieceEncoder, whole: Callable[[list[str]], list[bytes]], added: list[str]) -> Callable[[list[str]], list[bytes]]:
    """Texts that hold an added token go to the library as they are, so that its own rules find them."""

    def encode(texts: list[str]) -> list[bytes]:
        held = {i for i, t in enumerate(texts) if any(a in t for a in added)}
        if not held:
            return pieces(texts)
        rest = iter(pieces([t for i, t in enumerate(texts) if i not in held]))
        own = iter(whole([texts[i] for i in sorted(held)]))
        return [next(own if i in held else rest) for i in range(len(texts))]

    return encode


def _by_model(own) -> Callable[[list[str]], list[bytes]] | None:
    """Pieces by the library's model itself, which needn't split them again; None where the library does more to a piece than byte-level merges."""
    parts = json.loads(own.to_str())
    split, added = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
    if parts.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or parts["model"].get("type") != "BPE" or parts.get("truncation") or not all(t["special"] for t in added):
        return None
    tokenize = own.model.tokenize

    def encode(pieces: list[str]) -> list[bytes]:
        shown = _SEPARATOR.join(pieces).encode().decode("latin-1").translate(_BYTE_CHARS).split(_SHOWN_SEPARATOR)
        if len(shown) != len(pieces):  # a text holds the separator
            shown = [p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in pieces]
        found = list(map(tokenize, shown))
        data, ends = np.array([t.id for x in found for t in x], "<u4").tobytes(), [0, *accumulate(4 * len(x) for x in found)]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    return encode


def library_encoder(path: str, pattern: str, added: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Whole texts by the tokenizers library, which is asked once for each distinct piece.

    Its byte-level models split a text by ``pattern`` and merge each match by itself, so ids
    of the pieces, joined, are the ids of the whole text. Strings of added tokens in a text become
    their ids with ``added``, as the library does when nothing is set; without, those of special tokens are text.
    """
    key = (path, pattern, added)
    if key not in _library:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = not added

        line_end = own.encode("\n", add_special_tokens=False).ids

        def each(texts: list[str]) -> list[bytes]:
            return [np.array(x.ids, "<u4").tobytes() for x in own.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(pieces: list[str]) -> list[bytes]:
            """Strings without white space but a first space go to the library as lines of one text."""
            line = [len(p) > 0 and p[-1] != " " and _SPACE.search(p, 1) is None and p[0] not in _LINE_ENDS for p in pieces]
            lines = list(compress(pieces, line))
            if len(line_end) != 1 or not lines:
                return each(pieces)
            ids = np.array(own.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == line_end[0])
            if len(ends) != len(lines) - 1:
                return each(pieces)
            data, at = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            found = [data[a + 4 : b] for a, b in zip(at, at[1:])]
            if len(lines) == len(pieces):
                return found
            first, second = iter(found), iter(each([p for p, good in zip(pieces, line) if not good]))
            return [next(first if good else second) for good in line]

        pieces = PooledEncoder(pattern, _by_model(own) or encode, capacity=700_000)
        _library[key] = _with_added(pieces, each, [t.content for t in own.get_added_tokens_decoder().values()]) if added else pieces
    return _library[key]


def _bounds(df: DataFrame, id_col: str, buckets: int) -> list[int]:
    """Ids that cut the rows into about equal ranges: fewer than ``buckets`` numbers."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(id_col, shares, 10000)).head()[0]
    return sorted(set(found or []))


def write(df: DataFrame, id_col: str, text_col: str, path: str, encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, buckets: int | None = None) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the token files.

    ``id_col`` is an integer; a null id sorts first, equal ids follow each other in the order of their
    token ids. Null and empty texts have only the end id. Other columns are ignored. An empty
    table gives files without rows. One shuffle moves the ids, two or four bytes each.
    """
    spark = df.sparkSession
    ship(spark)
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(_bounds(df, id_col, buckets), np.int64)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, end = encoder(), np.array([end_id], "<u4")
        for batch in batches:
            for part in steps(batch, 1):
                ids = [np.concatenate((np.frombuffer(x, "<u4"), end)) for x in make(part.column(1).to_pylist())]
                data = [b"\2" + x.astype("<u2").tobytes() if x.max() < 65536 else b"\4" + x.tobytes() for x in ids]
                own = part.column(0)
                bucket = np.searchsorted(cuts, own.fill_null(np.iinfo(np.int64).min).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), own, pa.array(data, pa.binary())], ["bucket", "id", "ids"])

    encoded = rows.mapInArrow(encode, "bucket int, id long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "id", "ids")

    def block(held: list[tuple], bucket: int, number: int, ahead: int) -> pa.RecordBatch:
        ids = [np.frombuffer(x, f"<u{x[0]}", offset=1) for _, x in held]
        n = np.array([len(x) for x in ids], np.int64)
        row = [[bucket], [number], [ahead], [int(n.sum())], [[i for i, _ in held]], [pack(n)], [pack(np.concatenate(ids))]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["bucket", "block", "ahead", "n_tokens", "ids", "lengths", "tokens"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket, number, ahead = [], 0, None, 0, 0
        for batch in batches:
            for b, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (b != bucket or size >= BLOCK_IDS):
                    yield block(held, bucket, number, ahead)
                    held, size, number, ahead = [], 0, number + 1, ahead + size
                if b != bucket:
                    bucket, number, ahead = b, 0, 0
                held.append((i, x))
                size += len(x) // x[0]
        if held:
            yield block(held, bucket, number, ahead)

    dealt.mapInArrow(blocks, _BLOCKS).write.parquet(f"{path}/blocks")
    sums = _blocks(spark, path).groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/index")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Returns (``id_col``, start, n_tokens, ids BINARY as little-endian u32) of every document.

    ``start`` counts the ids of all documents before it. The index has one row for each bucket, at most
    as many as the shuffle partitions of the writer, and is broadcast.
    """
    ship(spark)
    index = spark.read.schema("bucket int, base long").parquet(f"{path}/index")
    table = _blocks(spark, path).join(F.broadcast(index), "bucket")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, lengths, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                n = unpack(lengths).astype(np.int64)
                end = np.cumsum(n)
                data, at = unpack(tokens).astype("<u4").tobytes(), [0, *(4 * end).tolist()]
                docs = [data[a:b] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + end - n), pa.array(n), pa.array(docs, pa.binary())], ["id", "start", "n_tokens", "ids"])

    rows = table.select((F.col("base") + F.col("ahead")).alias("first"), "ids", "lengths", "tokens")
    return rows.mapInArrow(decode, StructType().add("id", "long").add("start", "long").add("n_tokens", "long").add("ids", BinaryType())).withColumnRenamed("id", id_col)


def checksum(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian u32."""
    return F.crc32(ids)
