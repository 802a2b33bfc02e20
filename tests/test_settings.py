"""Settings from files of the search path, templates saved, created and loaded, picture hashes by name."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.functions import images
from ledgerloom.plans import export
from ledgerloom.plans.picture_queries import QUERIES, misfits
from ledgerloom.sources.records import records


def test_search_path(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(config.Path, "home", lambda: tmp_path / "home")
    assert config.found() is None and config.resolve(env={}) == config.Settings()
    (tmp_path / "config.json").write_text('{"cache_cap_mb": 7, "storage": {"duplicate_threshold": 0.5, "cache_cap_mb": 9}, "unknown": 1}')
    assert config.resolve(env={}).cache_cap_mb == 7 and config.resolve(env={}).duplicate_threshold == 0.5
    (tmp_path / "config").mkdir()
    (tmp_path / "config/config.yml").write_text("processing:\n  confidence_threshold: 0.3\n  max_image_side:\n")
    assert config.found() == config.Path("config/config.yml")
    got = config.resolve(env={"LEDGERLOOM_CACHE_CAP_MB": "11"})
    assert (got.confidence_threshold, got.cache_cap_mb, got.max_image_side) == (0.3, 11, 2048)
    own = tmp_path / "home" / config.OWN
    own.parent.mkdir(parents=True)
    own.write_text("cache_cap_mb: 5")
    assert config.found(tmp_path / "none") == own


@pytest.mark.parametrize("name, text", [("a.json", "{"), ("a.json", "[1]"), ("a.yaml", "a: [")])
def test_bad_files_are_left_out(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.warns(UserWarning, match="left out"):
        assert config.resolve(str(tmp_path / name), env={}) == config.Settings()
    with pytest.warns(UserWarning, match="left out"):
        assert config.read_file(tmp_path / "no such file.json") == {}


FIELDS = [{"source_field": "merchant.name", "export_name": "Shop"}, {"source_field": "amounts.total", "export_name": "Sum", "formatter": "currency", "default_value": "0"}]


def test_templates_are_saved_and_found(spark, sf, tmp_path):
    made = export.create("My Template", FIELDS, {"symbol": "", "date_format": "dd/MM/yyyy"}, export_formats=["CSV", "json"], business_fields={"team": "x", "boss": None})
    assert export.save(made, str(tmp_path)).name == "my_template.json"
    assert export.load(str(tmp_path))["my_template"] == made and made.formats == ("csv", "json") and made.constants == {"team": "x", "boss": ""}
    for t in export.TEMPLATES.values():
        assert export.from_dict(json.loads(json.dumps(export.as_dict(t)))) == t
    df = records(spark, sf, items=True).where("k < 50")
    assert export.apply(df, made).columns == ["Shop", "Sum", "team", "boss"] == export.header(made)
    assert export.apply(df, made).count() == df.count()


def test_bad_templates(tmp_path):
    with pytest.raises(ValueError, match="a template needs a field"):
        export.create("x", [])
    with pytest.raises(ValueError, match="not a template"):
        export.create("x", [{"source_field": "a"}])
    with pytest.warns(UserWarning, match="unknown format pdf"):
        assert export.create("x", FIELDS, export_formats=["pdf", "csv"]).formats == ("csv",)
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "list.json").write_text("[]")
    with pytest.warns(UserWarning, match="left out"):
        assert export.load(str(tmp_path)) == export.TEMPLATES


def test_suggestions_name_real_fields(spark, sf):
    paths = export.suggestions(records(spark, sf, items=True))
    assert "merchant.name" in paths["merchant"] and paths["items"] == ["items"] and "validation" not in paths
    used = {m.source for t in export.TEMPLATES.values() for m in t.fields if not m.source.startswith("validation")}
    assert used <= {p for section in paths.values() for p in section}


def test_hashes_by_name(spark):
    at = "/root/testdata/sf0.01"
    got = {r.picture_id: r for r in QUERIES["img_hashes"](spark, at).collect()}
    for r in misfits(spark, at).collect():
        if r.data is None or len(r.data) != r.width * r.height:
            assert got[r.picture_id].whash is None and got[r.picture_id].phash is None and got[r.picture_id].sharpness is None and got[r.picture_id].total_pixels is None
            continue
        grey = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
        assert (got[r.picture_id].phash, got[r.picture_id].dhash, got[r.picture_id].whash) == (images.phash(grey), images.dhash(grey), images.whash(grey))
        assert got[r.picture_id].sharpness == pytest.approx(images.quality(grey)["sharpness"], abs=1e-4) and got[r.picture_id].total_pixels == r.width * r.height
    assert images.hash_of("ahash", np.zeros((8, 8), np.uint8)) is None
    one = spark.createDataFrame([(b"abcd", 2, 2), (None, None, None)], "d binary, w int, h int")
    assert [r.x for r in one.select(images.hash_column(F.col("d"), F.col("w"), F.col("h"), "ahash").alias("x")).collect()] == [None, None]


def test_wavelet_hash_by_hand():
    grey = np.random.default_rng(5).integers(0, 256, (16, 16)).astype(float)
    p = np.pad(grey, 1, mode="reflect")
    k = [1, 2, 1]
    detail = [[grey[y, x] - sum(k[a] * k[b] * p[y + a, x + b] for a in range(3) for b in range(3)) / 16 for x in range(16)] for y in range(16)]
    small = [sum(detail[2 * y + a][2 * x + b] for a in (0, 1) for b in (0, 1)) / 4 for y in range(8) for x in range(8)]
    middle = (sorted(small)[31] + sorted(small)[32]) / 2
    want = int("".join("1" if v > middle else "0" for v in small), 2)
    assert images.whash(grey) == (want - (1 << 64) if want >> 63 else want)
