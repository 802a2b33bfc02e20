"""Hand-derived results on hand-written texts, and properties of operators."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.functions import formatting, hashing, images, merchants, text, truth, validation
from ledgerloom.operators import analytics, dedup
from ledgerloom.plans import export
from ledgerloom.registry import QUERIES
from ledgerloom.sources.records import records


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).head()[0]


@pytest.mark.parametrize(
    ("shown", "pattern", "wanted"),
    [
        ("Subtotal: 63.45\nTotal: $67.89", text.TOTAL, "63.45"),
        ("Total: $1,234.56", text.TOTAL, None),
        ("VAT 1.20", text.TAX, "1.20"),
        ("Grand total\n 9.99", text.TOTAL, "9.99"),
        ("", text.TOTAL, None),
        (None, text.TOTAL, None),
    ],
)
def test_amounts(spark, shown, pattern, wanted):
    assert one(spark, shown, lambda c: text.amount(c, pattern)) == (wanted and Decimal(wanted))


@pytest.mark.parametrize(
    ("shown", "wanted"),
    [
        ("2012-01-15", dt.date(2015, 12, 1)),
        ("2024-01-15", dt.date(2024, 1, 15)),
        ("01/15/68", dt.date(2068, 1, 15)),
        ("01/15/69", dt.date(1969, 1, 15)),
        ("March 3, 2021", dt.date(2021, 3, 3)),
        ("3 Mar 2021", dt.date(2021, 3, 3)),
        ("Mar. 3, 2021", None),
        ("1/2-2020", None),
        ("13/45/2020", None),
        (None, None),
    ],
)
def test_dates(spark, shown, wanted):
    assert one(spark, shown, text.date) == wanted


def test_numbers_and_payment(spark):
    assert one(spark, "Reference: 123", text.receipt_number) == "erence"
    assert one(spark, "American Express", text.payment_method) == "American"
    assert one(spark, "CASHIER: Ann", text.payment_method) == "CASH"
    assert one(spark, "Visa ending in 1234", text.card_last_four) == "1234"
    assert one(spark, "MILK 012345678901 3.99", text.phone) == "0123456789"
    assert one(spark, "at 2:05 PM today", text.time) == "2:05 PM"


def test_items(spark):
    got = one(spark, "2 MILK 3.98 7.96\nSubtotal: 7.96\nab 1.0\n", text.items)
    assert [(x.description, x.total_price, x.quantity) for x in got] == [("2 MILK 3.98", Decimal("7.96"), None), ("Subtotal:", Decimal("7.96"), None)]
    assert one(spark, None, text.items) == []


def test_clean_and_merchant(spark):
    assert one(spark, " a\n\tb ＄é ", text.clean) == "a b $"
    assert one(spark, "Corner Shop\n12345 Main", text.merchant_name) is None
    assert one(spark, "Corner Shop\nhello", text.merchant_name) == "Corner Shop hello"
    assert one(spark, "SHOP", text.merchant_name) is None
    assert one(spark, "Corner Shop\n12345 Main", lambda c: text.merchant_name(c, lines=True)) == "Corner Shop"


def test_templates(spark):
    assert one(spark, "Kroger in Target mall", merchants.merchant_type) == "target"
    assert one(spark, "nothing", merchants.merchant_type) is None
    items = one(spark, "Kroger\n12345 3.99\nbread 2.50 F", lambda c: merchants.template_items(c, F.lit("grocery")))
    assert [(x.description, str(x.total_price)) for x in items] == [("bread", "2.50")]
    costco = one(spark, "4 eggs 10.00", lambda c: merchants.template_items(c, F.lit("costco")))[0]
    assert (costco.quantity, costco.unit_price) == (4.0, Decimal("2.500000"))


def test_descriptions(spark):
    assert not one(spark, "taxi ride", merchants.valid_description)
    assert one(spark, "AB and C", merchants.valid_description)
    assert one(spark, "paper cup", merchants.category) is None
    assert one(spark, "dish soap", merchants.category) == "household"
    assert one(spark, "steak", merchants.category) == "beverages"


def test_enhance_is_idempotent(spark):
    df = spark.createDataFrame([("MILK $3.00\nMILK $3.00\nbread roll 2.00\n2 @ $1.50 = $3.00",)], "t string")
    empty = F.array().cast(merchants.ITEMS)
    got = df.select(merchants.enhance(F.col("t"), empty).alias("x")).select("x", merchants.dedup(F.col("x")).alias("y")).head()
    assert got.x == got.y
    assert [x.description for x in got.x] == ["MILK", "bread roll", "Item (qty: 2.0)"]


def test_truth(spark):
    row = spark.createDataFrame([(Decimal("0.00"), "", [1])], "a decimal(18,2), b string, c array<int>").select(truth.number("a"), truth.text("b"), truth.listed("c")).head()
    assert tuple(row) == (False, False, True)


def test_formatting(spark):
    assert one(spark, "+1 (555) 123-4567", formatting.phone) == "(555) 123-4567"
    assert one(spark, "$1,234.5", formatting.currency_text) == "$1234.50"
    assert one(spark, "n/a", formatting.currency_text) == "n/a"
    assert one(spark, 2.0, formatting.quantity, "double") == "2"
    assert one(spark, 0.125, formatting.percentage, "double") == "12.5%"
    assert one(spark, "31/12/2020", formatting.date_text) == "2020-12-31"


def test_week_and_season(spark):
    assert one(spark, dt.date(2024, 12, 30), analytics.week_key, "date") == "2024-W01"
    assert one(spark, dt.date(2024, 12, 1), analytics.season, "date") == "Winter"
    assert one(spark, "2:05 PM", analytics.hour) == 2


def test_validation_formats(spark):
    assert one(spark, "2:05 pm", validation.valid_time)
    assert not one(spark, "+15551234567", validation.valid_phone)
    assert not one(spark, "total", validation.reasonable_name)
    assert one(spark, "", validation.text_quality) == 0.0


def test_cumulative_ends_at_total(spark):
    rows = [("a", dt.date(2024, 1, 1), Decimal("1.10")), ("b", dt.date(2024, 1, 1), Decimal("0.40")), ("c", dt.date(2024, 1, 3), Decimal("2.00"))]
    got = {r.file_id: r.running_total for r in analytics.cumulative(spark.createDataFrame(rows, "file_id string, date date, total_amount decimal(18,2)")).collect()}
    assert got == {"b": 0.4, "a": 1.5, "c": 3.5}


def test_hash_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64).tolist()
    own = base + [b ^ (1 << i) for i, b in enumerate(base)] + [b ^ 7 for b in base] + base[:5]
    df = spark.createDataFrame(list(enumerate(own)), "id long, h long")
    got = {(r.id_1, r.id_2) for r in dedup.hash_pairs(df, "id", "h").collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if bits(own[i], own[j]) <= 3}
    groups = {r.id: r.group_id for r in dedup.groups(dedup.hash_pairs(df, "id", "h")).collect()}
    assert all(groups[i] == groups[j] for i, j in got)
    assert all(groups[i] <= i for i in groups)


def test_hashes_of_pictures(spark):
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (40, 60)).astype(np.uint8)
    assert bin(images.phash(grey) & (2**64 - 1)).count("1") <= 32
    df = spark.createDataFrame([(bytearray(grey.tobytes()), 60, 40)], "d binary, w int, h int")
    assert df.select(images.hash_column(F.col("d"), F.col("w"), F.col("h"))).head()[0] == images.phash(grey)
    assert images.structural_similarity(np.full((2, 2), 20), np.zeros((2, 2))) == pytest.approx(20 * np.log10(255 / 12) / 50)
    q = images.quality(grey)
    assert q["noise_level"] == q["sharpness"]


def test_median_hash_sign(spark):
    v = [float(i) for i in range(64, 0, -1)]
    assert one(spark, v, hashing.median_hash, "array<double>") == -(2**32)


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"cache_cap_mb": 5, "dedupe": false}')
    got = config.resolve(str(path), {"LEDGERLOOM_CACHE_CAP_MB": "7"}, confidence_threshold=0.5, dedupe=None)
    assert (got.cache_cap_mb, got.dedupe, got.confidence_threshold) == (7, False, 0.5)
    with pytest.raises(ValueError):
        config.resolve(None, {}, confidence_threshold=2.0)


def test_template_files(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "own.json").write_text('{"name": "own", "fields": [{"source_field": "merchant.name", "export_name": "M"}]}')
    assert "own" in export.load(str(tmp_path))
    assert export.problems(export.Template("", (), formats=("xml",))) == (["a template needs a name", "a template needs a field"], ["unknown format xml"])


def test_stream_drops_repeats(spark, tmp_path):
    from ledgerloom.streaming import ingest

    rows = [("a", dt.datetime(2024, 1, 1), "Total: 1.00", 0.9), ("a", dt.datetime(2024, 1, 1, 1), "Total: 1.00", 0.9), ("b", dt.datetime(2024, 1, 1), "Total: 2.00", 0.9)]
    schema = "file_id string, ts timestamp, raw_text string, ocr_confidence double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    df = ingest.extracted(ingest.once(ingest.source(spark, str(tmp_path / "in"), schema), "file_id", "ts")).select("file_id", "total_amount")
    ingest.write(df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_enhance_items_keeps_all_captured_items(spark, sf):
    from ledgerloom.registry import QUERIES

    key = ["file_id", "description"]
    captured, got = (QUERIES[q](spark, sf).select(*key).distinct() for q in ("dedup_items", "enhance_items"))
    assert captured.groupBy("file_id").count().where("count > 2").count() > 0
    assert captured.join(got, key, "left_anti").count() == 0


def test_enhance_adds_to_items_captured_in_part(spark):
    df = spark.createDataFrame([("MILK $3.00\nbread roll 2.00",)], "t string")
    part = F.slice(merchants.enhance(F.col("t"), F.array().cast(merchants.ITEMS)), 1, 1)
    got = df.select(merchants.enhance(F.col("t"), part).alias("x")).head()
    assert [x.description for x in got.x] == ["MILK", "bread roll"]


@pytest.mark.parametrize(("name", "key"), [("group_merchant", "merchant"), ("group_date", "day")])
def test_a_group_is_one_row_with_all_its_ids(spark, name, key):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).collect()
    valid = analytics.valid(records(spark, sf)).select(analytics.named().alias("merchant"), F.coalesce(F.col("date").cast("string"), F.lit("Unknown")).alias("day"), "file_id").collect()
    wanted = {}
    for r in valid:
        wanted.setdefault(r[key], []).append(r.file_id)
    assert len(rows) == len(wanted) and max(map(len, wanted.values())) > 100
    assert {r[key]: (r.n_records, r.file_ids) for r in rows} == {g: (len(ids), ",".join(sorted(ids))) for g, ids in wanted.items()}


def test_items_are_keyed_once(spark):
    """Strings of descriptions are made for each item, not within comparisons of pairs."""
    t = spark.createDataFrame([("Milk 1.00\n  MILK  2.00\nSalt 3.00", None)], "t string, n string")
    got = t.select(merchants.dedup(text.items(F.col("t"))).alias("x")).select(F.transform("x", lambda x: x["description"]).alias("d")).head().d
    assert got == ["Milk", "Salt"]
    plan = str(t.select(merchants.dedup(text.items(F.col("t"))))._jdf.queryExecution().analyzed())
    assert "regexp_replace" not in plan[plan.index("exists(") :].split(" ELSE ")[0]
