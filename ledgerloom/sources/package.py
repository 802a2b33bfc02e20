"""A package of export files as a sink: one write, files of several formats, a manifest of what was committed.

Rows (file, cells) are turned into texts of their format by Spark and go to parts of their file, which tasks write side by side; a file is a folder of parts. A task tells the rows and bytes
of its parts in its commit message, so the manifest lists committed parts only; parts of failed attempts are removed. CSV parts have a header each,
XLSX parts are workbooks of one sheet, as many as its rows need, JSON parts have an object to a line, TXT parts the first cell.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.cluster import ship

NAME, MANIFEST = "export_package", "manifest.json"
#: Rows of a sheet, and characters of its name, at most.
SHEET_ROWS, SHEET_NAME = 1_048_576, 31
#: Bits of a place below its partition.
BITS = 33
_NO_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
# The parts of a workbook of one sheet.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{}" sheetId="1" r:id="rId1"/></sheets></workbook>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_OPEN, _KEEP, _CLOSE, _NONE = '<c t="inlineStr"><is><t>', '<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>", "<c/>"
# Patterns of cells that CSV quotes, that XML escapes or drops, and whose white space XML must be told to keep; a cell's bounds are | in _ODD.
_QUOTED, _ESCAPED, _SPACED = '[,"\r\n]', "[^\\t\\n\\r\\x20-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]", "^\\s|\\s$|\\s\\s|[\\t\\n\\r]"
_ODD = "[&<>\\x00-\\x1f\\x{fffe}\\x{ffff}]|\\s\\s|\\s\\||\\|\\s|^\\s|\\s$"


def csv_cells(cells: Column) -> Column:
    """Cells as a line of CSV without its end; cells are looked at one by one only where one has to be quoted."""
    quoted = lambda c: F.when(c.rlike(_QUOTED), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.when(F.array_join(cells, "").rlike(_QUOTED), F.array_join(F.transform(cells, quoted), ",", "")).otherwise(F.array_join(cells, ",", ""))


def xml_cells(cells: Column) -> Column:
    """Cells of a sheet's row; cells are looked at one by one only where one has to be escaped."""

    def shown(c: Column) -> Column:
        x = F.regexp_replace(c, _ESCAPED, "")
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(char), F.lit(name))
        return F.when(c.isNull(), _NONE).otherwise(F.concat(F.when(c.rlike(_SPACED), _KEEP).otherwise(F.lit(_OPEN)), x, F.lit(_CLOSE)))

    plain = F.concat(F.lit(_OPEN), F.array_join(cells, _CLOSE + _OPEN, "\0"), F.lit(_CLOSE))
    plain = F.replace(plain, F.lit(f"{_OPEN}\0{_CLOSE}"), F.lit(_NONE))
    return F.when(F.array_join(cells, "|").rlike(_ODD), F.array_join(F.transform(cells, shown), "")).otherwise(plain)


def csv_row(line: Column) -> Column:
    """A line of cells with its end; that of a single empty cell is quoted, as the csv module does."""
    return F.concat(F.when(line == "", '""').otherwise(line), F.lit("\r\n"))


def xml_row(cells: Column) -> Column:
    return F.concat(F.lit("<row>"), cells, F.lit("</row>"))


def json_row(cells: Column, header: list[str]) -> Column:
    """An object of the columns; without columns the first cell is the object."""
    made = F.to_json(F.struct(*(F.get(cells, F.lit(i)).alias(h) for i, h in enumerate(header))), {"ignoreNullFields": "false"}) if header else F.get(cells, F.lit(0))
    return F.concat(made, F.lit("\n"))


def row(cells: Column, kind: str, header: list[str]) -> Column:
    """A row's text in its format."""
    if kind == "csv":
        return csv_row(csv_cells(cells))
    if kind == "xlsx":
        return xml_row(xml_cells(cells))
    return json_row(cells, header) if kind == "json" else F.concat(F.coalesce(F.get(cells, F.lit(0)), F.lit("")), F.lit("\n"))


def texts(rows: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Rows (file, cells) as (file, place, n, text): the text of n rows in the file's format, in the order of partitions."""
    text = F.lit(None).cast("string")
    for file, header in headers.items():
        text = F.when(F.col("file") == file, row(F.col("cells"), file.rpartition(".")[2], header)).otherwise(text)
    return rows.select("file", F.monotonically_increasing_id().alias("place"), F.lit(1).alias("n"), text.alias("text"))


class _Plain:
    """Texts of rows one after the other, after what its format begins with."""

    def __init__(self, out, name: str, header: list[str]):
        self.out = out

    def add(self, text: bytes) -> None:
        self.out.write(text)

    def close(self) -> None:
        self.out.close()


class _Csv(_Plain):
    def __init__(self, out, name: str, header: list[str]):
        super().__init__(out, name, header)
        line = io.StringIO(newline="")
        csv.writer(line).writerow(header)
        out.write(line.getvalue().encode())


class _Xlsx(_Plain):
    def __init__(self, out, name: str, header: list[str]):
        self.file, self.zip = out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=ZIP_LEVEL)
        title = re.sub(r"[\[\]:*?/\\]", " ", name)[:SHEET_NAME]
        for path, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK.format(escape(title, {'"': "&quot;"}))), ("xl/_rels/workbook.xml.rels", _RELS)):
            self.zip.writestr(path, text)
        self.out = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        cells = "".join(f"{_KEEP}{escape(_NO_XML.sub('', c))}{_CLOSE}" for c in header)
        self.out.write(f"{_SHEET}<row>{cells}</row>".encode())

    def close(self) -> None:
        self.out.write(b"</sheetData></worksheet>")
        self.out.close()
        self.zip.close()
        self.file.close()


FORMATS = {"csv": _Csv, "xlsx": _Xlsx, "json": _Plain, "txt": _Plain}
#: How texts can be compressed, and the endings that their parts get; workbooks are compressed by themselves.
CODECS = {"none": "", "gzip": ".gz", "zstd": ".zst"}
#: Levels of compression, of texts and of workbooks; bytes that are compressed at once.
LEVEL, ZIP_LEVEL, FRAME = 6, 9, 1 << 22


class _Frames:
    """Compresses what is written, frame after frame: pyarrow's own streams take no level."""

    def __init__(self, out, codec: str):
        self.out, self.codec, self.held = out, pa.Codec(codec, LEVEL), bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        if len(self.held) >= FRAME:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write(self.codec.compress(bytes(self.held), asbytes=True))
            self.held = bytearray()

    def close(self) -> None:
        self._flush()
        self.out.close()


@dataclass
class Part:
    file: str
    path: str
    place: int
    rows: int
    bytes: int


@dataclass
class Committed(D.WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder)) if re.match("[a-z0-9]+:/", folder) else (fs.LocalFileSystem(), folder)


def _fitting(kind: str, rows: int, n: int, text: bytes) -> Iterator[tuple[int, bytes]]:
    """(rows, text) of a text of n rows, after so many rows of a part; a sheet's is cut where the sheet is full."""
    if kind != "xlsx" or rows + n < SHEET_ROWS:
        yield n, text
        return
    end = b"</row>"
    each = [x + end for x in text.split(end)[:-1]]
    while each:
        fit = SHEET_ROWS - 1 - rows
        if fit:
            yield len(each[:fit]), b"".join(each[:fit])
        each, rows = each[fit:], 0


class PackageWriter(D.DataSourceArrowWriter):
    def __init__(self, folder: str, headers: dict[str, list[str]], codec: str = "none"):
        self.folder, self.headers, self.codec = folder, headers, codec

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        """A part of each file and each partition of places that the task's rows name, in the order of the rows; all of a partition stay open, as rows of files may come in turns.

        Parts have the place of their first row in their names, so their order is that of places, whichever task wrote them.
        """
        store, root = _store(self.folder)
        done, opened, attempt = Committed(), {}, uuid4().hex[:8]

        def close(file: str) -> None:
            out, part = opened.pop(file)
            out.close()
            part.bytes = store.get_file_info(f"{root}/{part.path}").size

        def add(file: str, kind: str, place: int, n: int, text: bytes) -> None:
            if file in opened and (opened[file][1].place >> BITS != place >> BITS or kind == "xlsx" and opened[file][1].rows + n >= SHEET_ROWS):
                close(file)
            if file not in opened:
                codec = "none" if kind == "xlsx" else self.codec
                path = f"{file}/part-{place >> BITS:05d}-{place % (1 << BITS):010d}-{len(done.parts):05d}-{attempt}.{kind}{CODECS[codec]}"
                store.create_dir(f"{root}/{file}", recursive=True)
                stem = file.rpartition("/")[2].rpartition(".")[0]
                done.parts.append(Part(file, path, place, 0, 0))
                out = store.open_output_stream(f"{root}/{path}", compression=None)
                opened[file] = FORMATS[kind](out if codec == "none" else _Frames(out, codec), stem, self.headers.get(file, [])), done.parts[-1]
            out, part = opened[file]
            out.add(text)
            part.rows += n

        for batch in iterator:
            mine: dict[tuple[str, int], list[tuple[int, int, bytes]]] = {}
            columns = (batch.column(c).to_pylist() for c in ("file", "place", "n"))
            for file, place, n, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                mine.setdefault((file, place >> BITS), []).append((place, n, text))
            for (file, _), each in mine.items():
                kind, n, place = file.rpartition(".")[2], sum(n for _, n, _ in each), each[0][0]
                rows = opened[file][1].rows if file in opened and opened[file][1].place >> BITS == place >> BITS else 0
                for k, text in _fitting(kind, rows, n, b"".join(x for _, _, x in each)):
                    add(file, kind, place, k, text)
        for file in list(opened):
            close(file)
        return done

    def commit(self, messages: list[Committed | None]) -> None:
        """The manifest, a row for each file, those without rows too; anything else in the files' folders goes."""
        store, root = _store(self.folder)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.file, p.place, p.path))
        kept = {f"{root}/{p.path}" for p in parts}
        files = []
        for name in self.headers:
            mine = [p for p in parts if p.file == name]
            files.append({"file": name, "rows": sum(p.rows for p in mine), "bytes": sum(p.bytes for p in mine), "parts": [p.path.rpartition("/")[2] for p in mine]})
            for x in store.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True)):
                if x.path not in kept:
                    store.delete_file(x.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write("".join(json.dumps(f) + "\n" for f in files).encode())

    def abort(self, messages: list[Committed | None]) -> None:
        store, root = _store(self.folder)
        for p in (p for m in messages if m for p in m.parts):
            store.delete_file(f"{root}/{p.path}")


class Package(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, place long, n int, text string"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], json.loads(self.options["headers"]), self.options["codec"])


def write(rows: DataFrame, folder: str, headers: dict[str, list[str]], codec: str = "none") -> DataFrame:
    """Writes rows (file, cells), or texts of rows (file, place, n, text), to a package and returns its manifest (file, rows, bytes, parts); ``headers`` names every file and its columns.

    A file's ending is its format. Rows come in the order of their partitions, texts in that of places, numbers as those of ``monotonically_increasing_id``. ``codec`` compresses parts of texts, all but workbooks.
    """
    spark = rows.sparkSession
    unknown = [f for f in headers if f.rpartition(".")[2] not in FORMATS]
    if unknown:
        raise ValueError(f"no such format: {', '.join(unknown)}")
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")
    ship(spark)
    spark.dataSource.register(Package)
    made = texts(rows, headers) if "cells" in rows.columns else rows.select("file", "place", "n", "text")
    made.write.format(NAME).mode("append").option("headers", json.dumps(headers)).option("codec", codec).save(folder)
    return spark.read.schema("file string, rows long, bytes long, parts array<string>").json(f"{folder}/{MANIFEST}")
