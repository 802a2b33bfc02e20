"""The whole way of a picture: stages at which rows fail, steps that fail without failing the row, item parse, validation."""

import datetime as dt

import numpy as np

from ledgerloom.operators import process

TEXT = "WALMART Supercenter\n12 Main St\nBREAD 2.50 T\nMILK 3.00 T\nSUBTOTAL 5.50\nTAX 0.44\nTOTAL 5.94\nVisa ending in 1234\n03/04/2024"
SCHEMA = "id int, data binary, width int, height int, vision_ok boolean, vision_conf double, vision_text string, doc_ok boolean, doc_conf double, doc_text string, tess_ok boolean, tess_conf double, tess_text string"


def rows():
    grey = np.random.default_rng(1).integers(0, 256, (24, 32)).astype(np.uint8).tobytes()
    none = (False, None, None)
    return [
        (1, grey, 32, 24, True, 0.9, TEXT, *none, *none),
        (2, None, 32, 24, True, 0.9, TEXT, *none, *none),  # no bytes
        (3, grey, 32, 24, *none, *none, *none),  # no engine
        (4, grey, 32, 24, *none, *none, True, 0.1, ""),  # read, but blank
        (5, grey, 32, 24, None, None, None, True, 0.8, TEXT, *none),
    ]


def test_stages_and_errors(spark):
    df = process.gated(spark.createDataFrame(rows(), SCHEMA))
    got = {r.id: r for r in process.process(df, dt.date(2024, 4, 1), parse=True).collect()}
    assert {i: r.stage for i, r in got.items()} == {1: None, 2: "load", 3: "recognise", 4: "extract", 5: None}
    assert got[2].error == "ValueError: Could not load image" and got[3].error == process.NO_METHOD and got[4].error == process.NO_TEXT
    assert got[1].merchant_type == "walmart" and [(i.description, str(i.total_price)) for i in got[1]["items"]][:2] == [("BREAD", "2.50"), ("MILK", "3.00")]
    assert str(got[1].total_amount) == "5.50"  # the template's pattern takes the first amount after "total", of the subtotal
    assert got[5].ocr_method == "document_detection" and got[5].is_valid is not None and got[5].validation_score < got[1].validation_score
    assert got[1].quality.total_pixels == 768 and got[1].made is not None and got[1].failed_step is None
    for i in (2, 3, 4):
        assert got[i].validation_score is None and got[i].confidence_score is None and got[i]["items"] == [] and got[i].is_valid is None and got[i].merchant_name is None
    assert got[2].quality is None and got[3].quality is not None


def test_a_failed_step_does_not_fail_the_row(spark):
    df = process.gated(spark.createDataFrame(rows()[:1], SCHEMA), steps=("sharpen", "denoise"), options={"denoise": {"window": None}})
    r = process.process(df).head()
    assert r.failed_step == "denoise" and r.stage is None and r.success and bytes(r.made) == bytes(r.data)


def test_no_rows(spark):
    df = process.gated(spark.createDataFrame([], SCHEMA))
    assert process.process(df, dt.date(2024, 4, 1), parse=True).count() == 0
