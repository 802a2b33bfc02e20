"""Packages: files as the manifest counts them, contents by format, order of parts, what fails."""

import csv
import datetime as dt
import io
import json
import re
import time
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import validation as V
from ledgerloom.operators import analytics as A
from ledgerloom.plans import export, service_queries, sinks
from ledgerloom.sources import package
from ledgerloom.sources.records import records


@pytest.fixture(scope="module")
def df(spark, sf):
    return V.validate(records(spark, sf, items=True, text=True).where("k < 300"), dt.date(2008, 1, 1)).cache()


@pytest.fixture(scope="module")
def made(df, tmp_path_factory):
    at = tmp_path_factory.mktemp("package")
    return at, {r.file: r for r in sinks.write_package(df, str(at), "all").collect()}


def sheet(path):
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        tree = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    return [["".join(t.text or "" for t in c.iter(f"{space}t")) for c in row] for row in tree.iter(f"{space}row")]


def lines(at, entry):
    """Rows of a file, part after part."""
    out = []
    for name in entry.parts:
        path = at / entry.file / name
        if name.endswith(".xlsx"):
            out += sheet(path)[1:]
        elif name.endswith(".csv"):
            out += list(csv.reader(path.open(encoding="utf-8", newline="")))[1:]
        else:
            out += path.read_text(encoding="utf-8").splitlines()
    return out


def test_manifest_is_what_lies_there(df, made):
    at, files = made
    found = {str(p.relative_to(at)) for p in at.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == {f"{f}/{p}" for f, e in files.items() for p in e.parts} | {package.MANIFEST}
    assert all(e.bytes == sum((at / e.file / p).stat().st_size for p in e.parts) for e in files.values())
    assert all(e.rows == len(lines(at, e)) for e in files.values() if e.file != "reports/summary.txt")
    counts = sinks.package_counts(df, df.sparkSession.createDataFrame(list(files.values()))).head()
    kinds = [f.split("/")[0] for f in files]
    assert (counts.spreadsheet_files, counts.report_files, counts.template_files) == tuple(kinds.count(k) for k in ("spreadsheets", "reports", "templates"))
    assert counts.total_files_created == len(files) == 14 and counts.templates_used == 3 and counts.receipts_processed == df.where("success").count()


def test_templates_in_their_formats(df, made):
    at, files = made
    for name in sinks.PACKAGE:
        t = export.TEMPLATES[name]
        want = export.apply(A.valid(df), t, "file_id").orderBy("file_id").drop("file_id")
        rows = [["" if v is None else str(v) for v in r] for r in want.collect()]
        assert want.columns == export.header(t) and {f for f in files if f"/{name}." in f} == {f"templates/{name}.{k}" for k in t.formats}
        for kind in t.formats:
            got = lines(at, files[f"templates/{name}.{kind}"])
            if kind == "json":
                assert [["" if v is None else v for v in json.loads(x).values()] for x in got] == rows
            elif kind == "csv":
                assert got == rows
            else:
                assert got == [[re.sub(r"\r", "\n", v) for v in r] for r in rows]


def test_sheets_and_reports(df, made):
    at, files = made
    n = df.where("success").count()
    shown = [json.loads(x) for x in lines(at, files["spreadsheets/receipts.json"])]
    assert len(shown) == n and set(shown[0]) == {"file_info", "ocr_info", "receipt_data", "validation"}
    flat = lines(at, files["spreadsheets/receipts.csv"])
    assert len({r[0] for r in flat}) == n and flat == lines(at, files["spreadsheets/receipts.xlsx"])
    report = lines(at, files["reports/summary.txt"])
    assert report[0].startswith("Total Receipts Processed: ") and sum(x.startswith("   Merchant: ") for x in report) == n
    places = [int(x.split(".")[0]) for x in report if re.match(r"\d+\. ", x)]
    assert places == list(range(1, n + 1))
    merchants = lines(at, files["reports/spending_by_merchant.csv"])
    assert [float(r[1]) for r in merchants] == sorted((float(r[1]) for r in merchants), reverse=True)


def test_unknown_templates_are_entries(df, tmp_path):
    names = ("personal_expenses", "unknown")
    files = sinks.write_package(df.where("k < 20"), str(tmp_path), "csv", names, reports=False).collect()
    assert {f.file for f in files} == {"spreadsheets/receipts.csv", "templates/personal_expenses.xlsx", "templates/personal_expenses.csv", "reports/summary.txt"}
    assert sinks.missing_templates(names) == [{"template_name": "unknown", "success": False, "error": "Template not found"}]


def test_no_records(df, tmp_path):
    files = {r.file: r for r in sinks.write_package(df.where("k < 0"), str(tmp_path)).collect()}
    assert files["spreadsheets/receipts.csv"].rows == 0 and files["spreadsheets/receipts.csv"].parts == []
    counts = sinks.package_counts(df.where("k < 0"), df.sparkSession.createDataFrame(list(files.values()))).head()
    assert (counts.spreadsheet_files, counts.template_files, counts.receipts_processed) == (0, 0, 0)


def test_failed_write_commits_nothing(spark, tmp_path):
    rows = spark.range(100).repartition(4).select(F.lit("a.csv").alias("file"), F.array(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))).alias("cells"))
    with pytest.raises(Exception, match="broken"):
        package.write(rows, str(tmp_path), {"a.csv": ["id"]})
    assert not (tmp_path / package.MANIFEST).exists()
    package.write(rows.where("element_at(cells, 1) IS NOT NULL").limit(0), str(tmp_path), {"a.csv": ["id"]})  # removes what was left
    assert not list((tmp_path / "a.csv").glob("part-*"))
    with pytest.raises(ValueError, match="no such format"):
        package.write(rows, str(tmp_path), {"a.pdf": ["id"]})


def test_cells_that_formats_must_escape(spark, tmp_path):
    cells = ['a,"b"', "<&>\x00", "two\nlines", None, "é  "]
    df = spark.createDataFrame([(f"x.{k}", cells) for k in ("csv", "xlsx", "json")], "file string, cells array<string>")
    files = {r.file: r for r in package.write(df.repartition(1), str(tmp_path), {f"x.{k}": list("abcde") for k in ("csv", "xlsx", "json")}).collect()}
    assert lines(tmp_path, files["x.csv"]) == [['a,"b"', "<&>\x00", "two\nlines", "", "é  "]]
    assert lines(tmp_path, files["x.xlsx"]) == [['a,"b"', "<&>", "two\nlines", "", "é  "]]
    assert json.loads(lines(tmp_path, files["x.json"])[0]) == dict(zip("abcde", cells))


def test_groups_are_numbered_without_one_task(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("Vendor"), F.col("id").alias("key"))
    got = sinks.mapped_groups(df, "Vendor", "key", per=100)
    assert sorted(r.place for r in got.where("group = 'hot'").select("place").collect()) == list(range(1, 1001))
    assert got.where("group = ''").agg(F.max("place")).head()[0] == 1000 and got.count() == 3000


def test_rows_of_files_in_turns_share_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"{f}.{k}", [str(i)]) for i in range(3) for f, k in (("a", "csv"), ("b", "json"), ("c", "xlsx"))], "file string, cells array<string>").coalesce(1)
    files = {r.file: r for r in package.write(rows, str(tmp_path), {"a.csv": ["n"], "b.json": ["n"], "c.xlsx": ["n"]}).collect()}
    assert all(len(r.parts) == 1 and r.rows == 3 and r.bytes > 0 for r in files.values())
    assert lines(tmp_path, files["a.csv"]) == lines(tmp_path, files["c.xlsx"]) == [["0"], ["1"], ["2"]]


def test_sheets_are_written_from_ordered_records(spark, df, made):
    at, files = made
    flat = lines(at, files["spreadsheets/receipts.csv"])
    names, places = [r[0] for r in flat], [int(r[18] or -1) for r in flat]
    assert export_names(df) == list(dict.fromkeys(names)) and len(set(zip(names, places))) == len(flat)
    assert all(b == a + 1 for a, b, n, m in zip(places, places[1:], names, names[1:]) if n == m) and all(b <= 0 for b, n, m in zip(places[1:], names, names[1:]) if n != m)


def export_names(df):
    return [r.file_name for r in A.successful(df).orderBy("file_id").select("file_name").collect()]


def test_codec_keeps_every_row(df, made, tmp_path):
    at, files = made
    small = {r.file: r for r in sinks.write_package(df, str(tmp_path), "all", codec="zstd").collect()}
    assert {f: r.rows for f, r in small.items()} == {f: r.rows for f, r in files.items()}
    for f, r in small.items():
        if f.endswith(".xlsx"):
            assert lines(tmp_path, r) == lines(at, files[f])
            continue
        assert all(p.endswith(".zst") for p in r.parts)
        head = 1 if f.endswith(".csv") else 0
        text = [x for p in r.parts for x in pa.input_stream(str(tmp_path / f / p), compression="zstd").read().decode().splitlines()[head:]]
        assert text == [x for p in files[f].parts for x in (at / f / p).read_text(encoding="utf-8").splitlines()[head:]]
    big = "spreadsheets/receipts.json"
    assert small[big].bytes * 4 < files[big].bytes
    with pytest.raises(ValueError, match="no such codec"):
        package.write(df.select(F.lit("a.csv").alias("file"), F.array("file_id").alias("cells")), str(tmp_path), {"a.csv": ["id"]}, codec="lzo")


def test_queries_leave_a_small_package_and_no_shuffle_files(spark, sf):
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    files = service_queries._packaged(spark, sf)[1].collect()
    assert len(files) == 14 and all(p.endswith((".zst", ".xlsx")) for r in files for p in r.parts)
    for _ in range(40):
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left


def test_parts_follow_places(spark, tmp_path):
    rows = [("a.csv", (p << package.BITS) + i, 1, f"{p}-{i}\r\n") for p in (2, 0, 1) for i in range(3)]
    made = spark.createDataFrame(rows, "file string, place long, n int, text string").coalesce(1)
    (entry,) = package.write(made, str(tmp_path), {"a.csv": ["x"]}).collect()
    assert len(entry.parts) == 3 and entry.rows == 9
    assert lines(tmp_path, entry) == [[f"{p}-{i}"] for p in range(3) for i in range(3)]


def test_full_sheets_are_cut(monkeypatch):
    monkeypatch.setattr(package, "SHEET_ROWS", 4)
    text = b"".join(b"<row>%d</row>" % i for i in range(8))
    got = list(package._fitting("xlsx", 1, 8, text))
    assert [n for n, _ in got] == [2, 3, 3] and b"".join(x for _, x in got) == text
    assert list(package._fitting("xlsx", 3, 1, b"<row/></row>")) == [(1, b"<row/></row>")]
    assert list(package._fitting("csv", 3, 8, text)) == [(8, text)]


def test_texts_are_those_of_the_csv_module(spark, tmp_path):
    cells = [["", None], [" a ", "b  c"], ['"', ",\r"], ["|x| y", "&lt;"], ["\x00", "\ttab"], ["\U0001f600", "￾]]>"]]
    df = spark.createDataFrame([(f"x.{k}", c) for c in cells for k in ("csv", "xlsx")], "file string, cells array<string>").coalesce(1)
    files = {r.file: r for r in package.write(df, str(tmp_path), {f"x.{k}": ["a", "b"] for k in ("csv", "xlsx")}).collect()}
    want = io.StringIO(newline="")
    csv.writer(want).writerows([["a", "b"], *(["" if v is None else v for v in c] for c in cells)])
    (part,) = files["x.csv"].parts
    assert (tmp_path / "x.csv" / part).read_bytes() == want.getvalue().encode()
    drop = lambda v: re.sub("[\x00￾]", "", re.sub("\r", "\n", v or ""))
    assert lines(tmp_path, files["x.xlsx"]) == [[drop(v) for v in c] for c in cells]


def test_own_formatters_see_whole_items(df):
    t = export.Template("own", (export.Mapping("items", "Last", "last_price"), export.Mapping("items", "Names", "items_summary")), formats=("csv",))
    export.fmt.FORMATTERS["last_price"] = lambda c: F.get(c, F.size(c) - 1)["total_price"]
    try:
        held, (cells,) = export.held(df, [t])
        want = {r.file_id: [r.Last, r.Names] for r in export.apply(df, t, "file_id").collect()}
        assert {r.file_id: r.cells for r in held.select("file_id", cells.alias("cells")).collect()} == want
        assert any(v[0] for v in want.values())
    finally:
        del export.fmt.FORMATTERS["last_price"]


def test_frames_are_one_text(tmp_path, monkeypatch):
    monkeypatch.setattr(package, "FRAME", 100)
    for codec in ("zstd", "gzip"):
        out = package._Frames((tmp_path / codec).open("wb"), codec)
        for i in range(1000):
            out.write(b"%d\n" % i)
        out.close()
        assert pa.input_stream(str(tmp_path / codec), compression=codec).read() == b"".join(b"%d\n" % i for i in range(1000))
