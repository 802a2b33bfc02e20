"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables. ``payloads`` holds each payload's bytes once, by its
SHA-256 and length (zstd-compressed); a second digest of every copy is compared when it is stored, so
two payloads are never taken for one. ``headers`` holds the exact header text of each record. Joining
them by digest gives back every record, byte for byte; the digest is checked again then.

Of the records with equal payloads of at least ``min_bytes``, that with the smallest page id is a
response and the others are revisits that refer to it (their record has no block); all smaller
ones are responses. Rows with equal ids and payloads are all of the same type. A null page id is never
referred to while another page has the payload. A null payload is empty, a null URL is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

#: Fixed values of the format.
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAME = "urn:page:"


def _line(name: str, *value: Column | str) -> Column:
    """A header line; null, thus no line, if a value is null."""
    return F.concat(F.lit(f"{name}: "), *(v if isinstance(v, Column) else F.lit(v) for v in value), F.lit(END))


def _header(page_id: Column, url: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    revisit = refers_to.isNotNull()
    uri = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat_ws(
        "",
        F.lit(f"WARC/1.0{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", f"<{NAME}", page_id.cast("string"), ">"),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", "sha256:", digest),
        _line("WARC-Refers-To", f"<{NAME}", refers_to.cast("string"), ">"),
        F.when(revisit, _line("WARC-Profile", PROFILE)),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(END),
    )


def write(pages: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 100) -> None:
    """Writes the archive. One shuffle moves each task's distinct payloads, one narrow rows."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8") if pages.schema[payload_col].dataType.simpleString() == "string" else F.col(payload_col), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        own = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            data = [x.as_buffer() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary()),
                    pa.array([own.compress(x) for x in data], pa.binary()),
                ],
                ["page_id", "digest", "size", "proof", "data"],
            )

    pressed = rows.select("page_id", "payload").mapInArrow(press, "page_id long, digest string, size long, proof binary, data binary")
    once = pressed.groupBy("digest", "size").agg(
        F.min("page_id").alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.min("proof").alias("proof"),
        F.max("proof").alias("proof_2"),
        F.first("data").alias("data"),
    )
    same = F.when(F.col("proof") == F.col("proof_2"), F.col("data")).otherwise(F.raise_error(F.lit("different payloads with one digest")).cast("binary"))
    once.select("digest", "size", "first", "copies", same.alias("data")).write.option("compression", "none").parquet(f"{path}/payloads")

    repeated = _payloads(pages.sparkSession, path).where((F.col("copies") > 1) & (F.col("size") >= min_bytes)).select("digest", "size", "first")
    narrow = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    typed = narrow.join(repeated, ["digest", "size"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed.select("page_id", "digest", "size", _header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers).alias("header")).write.parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, size long, first long, copies long, data binary").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Returns (header, payload BINARY) of every record, the payload in full for revisits too.

    Headers are joined to payloads by digest and length; a digest that many records share is a skewed
    key that adaptive execution splits.
    """
    ship(spark)
    headers = spark.read.schema("page_id long, digest string, size long, header string").parquet(f"{path}/headers")
    joined = headers.join(_payloads(spark, path).select("digest", "size", "data"), ["digest", "size"], "left").select("header", "digest", "size", "data")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        own = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for digest, size, data in zip(*(c.to_pylist() for c in part.columns[1:])):
                    payload = own.decompress(data, max_output_size=max(size, 1))
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload {digest} is damaged")
                    out.append(payload)
                for header, payload in zip(part.column(0).to_pylist(), out):
                    _parsed(header.encode(), payload)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["header", "payload"])

    return joined.mapInArrow(expand, "header string, payload binary")


def _parsed(header: bytes, payload: bytes) -> None:
    """Rebuilds the record and reads it as a file's reader would; raises if its framing is wrong."""
    block = b"" if b"\r\nWARC-Type: revisit\r\n" in header else payload
    lines, _, rest = (header + block + END.encode() * 2).partition(END.encode() * 2)
    fields = dict(x.split(b": ", 1) for x in lines.split(END.encode())[1:])
    length = int(fields[b"Content-Length"])
    if not lines.startswith(b"WARC/1.0\r\n") or rest[:length] != block or rest[length:] != END.encode() * 2:
        raise ValueError(f"the record {fields.get(b'WARC-Record-ID')} has a wrong frame")


def record(header: Column, payload: Column) -> Column:
    """The bytes of the record as a WARC file has them: a revisit has no block."""
    block = F.when(field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(F.encode(header, "UTF-8"), block, F.lit(END.encode() * 2))


def field(header: Column, name: str) -> Column:
    """A header's value, null if the line is absent."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def page_of(header: Column, name: str = "WARC-Record-ID") -> Column:
    """The page id that a header names, null if none."""
    return F.regexp_extract(F.coalesce(field(header, name), F.lit("")), rf"{NAME}(-?\d+)", 1).try_cast("long")
