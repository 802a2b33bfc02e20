"""Scans, assembly and sinks on small made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import validation as V
from ledgerloom.operators import process
from ledgerloom.plans import sinks
from ledgerloom.sources import library
from ledgerloom.sources.records import records

CANDIDATES = "file_id string, vision_ok boolean, vision_conf double, vision_text string, doc_ok boolean, doc_conf double, doc_text string, tess_ok boolean, tess_conf double, tess_text string, problem string"


def test_failures_become_rows(spark):
    text = "Corner Market\nBread loaf 2.50\nTotal: $2.50"
    rows = [
        ("good", True, 0.9, text, True, 0.9, "other", True, 0.9, "other", None),
        ("weak", True, 0.2, "other", True, 0.3, "other", True, 0.1, text, None),
        ("none", False, None, None, None, None, None, None, None, None, None),
        ("unread", True, 0.9, text, None, None, None, None, None, None, "cannot read image"),
        ("empty", True, 0.9, None, None, None, None, None, None, None, None),
    ]
    got = {r.file_id: r for r in process.process(spark.createDataFrame(rows, CANDIDATES), dt.date(2024, 1, 1)).collect()}
    assert len(got) == 5
    assert (got["good"].ocr_method, str(got["good"].total_amount)) == ("google_vision", "2.50")
    assert (got["weak"].ocr_method, str(got["weak"].total_amount)) == ("tesseract", "2.50")
    assert (got["none"].success, got["none"].error, got["none"].ocr_confidence) == (False, process.NO_METHOD, 0.0)
    assert (got["unread"].ocr_method, got["unread"].error, got["unread"].raw_text, got["unread"].confidence_score) == ("none", "cannot read image", "", None)
    assert (got["empty"].success, got["empty"].raw_text, got["empty"].total_amount) == (True, "", None)
    assert process.text_only(spark.createDataFrame([], CANDIDATES)).count() == 0


@pytest.mark.parametrize(("n", "held"), [(0, 0), (100, 100), (101, 50), (102, 51), (151, 100), (152, 50)])
def test_ring(n, held):
    kept = []
    for i in range(n):
        kept.append(i)
        kept = kept[-50:] if len(kept) > 100 else kept
    assert sinks.ring(n) == len(kept) == held


def test_report_of_no_records(spark, sf):
    lines = [r.line for r in sinks.report(records(spark, sf, items=True).where("k < 0")).collect()]
    assert sorted(lines) == ["Success Rate: 0.0%", "Successfully Parsed: 0", "Total Amount: $0.00", "Total Receipts Processed: 0"]


def test_templates_without_a_match(spark, sf):
    assert sinks.many(records(spark, sf, items=True), ("no such template",)).count() == 0
    assert sinks.kinds("PARQUET") == sinks.export.FORMATS


def test_folder_filters_reach_the_scan(spark, sf, tmp_path):
    spark.range(20).select(F.col("id").alias("file_id"), F.lit("image/png").alias("mime"), (F.col("id") % 3).alias("parent"), F.lit(None).cast("boolean").alias("trashed")).write.parquet(f"{tmp_path}/f")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else the list of filters is cut short
    got = library.folder_images(spark.read.parquet(f"{tmp_path}/f"), 1)
    assert got.count() == 7
    plan = got._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(parent,1)" in plan.split("PushedFilters")[1]
