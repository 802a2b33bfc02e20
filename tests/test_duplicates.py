"""Hash duplicates by classes against brute force, with parts of hashes that most share; structural similarity; the listing source."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import cluster
from ledgerloom.functions.images import structural_similarity
from ledgerloom.operators import dedup
from ledgerloom.plans.service_queries import _files
from ledgerloom.sources import listing


def hashes(seed=1, n=400):
    """Half the rows share one hash; most others differ from it in few high bits, so parts of theirs are the same everywhere."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 2:
            out.append((i, 0))
        elif i % 3:
            out.append((i, sum(1 << b for b in rnd.sample(range(40, 63), rnd.randrange(1, 6)))))
        else:
            out.append((i, rnd.getrandbits(63) - (1 << 62)))
    out += [(n + j, out[3 * j][1] ^ (1 << (j % 60))) for j in range(20)]
    return out


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


@pytest.mark.parametrize("hot", [2, 256])
def test_pairs_matches_and_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT", hot)
    rows = hashes()
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (None, 5), (900, None)]], "file long, hash long, similarity string")
    pairs = {(a, b): 1 - bits(x, y) / 64 for a, x in rows for b, y in rows if a < b and bits(x, y) <= 3}
    found = dedup.hash_pairs(df, "file", "hash").collect()
    assert {(r.id_1, r.id_2): r.similarity for r in found} == pairs and len(found) == len(pairs)
    best = {}
    for (a, b), s in sorted(pairs.items()):
        best[b] = max(best.get(b, (0, 0)), (s, -a))
    assert {r.id: (r.similarity, -r.match_id) for r in dedup.best_matches(df, "file", "hash").collect()} == best
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    group = {}
    for i in sorted(near):
        if i not in group:
            walk = [i]
            while walk:
                x = walk.pop()
                if x not in group:
                    group[x] = i
                    walk.extend(near[x])
    assert {r.id: r.group_id for r in dedup.hash_groups(df, "file", "hash").collect()} == group


def test_a_shared_hash_makes_no_pairs_of_rows(spark):
    """Half of 20,000 rows share a hash: links are between hashes, results one row for each id."""
    df = spark.range(20000).select(F.col("id").alias("file"), F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).otherwise(F.xxhash64("id")).alias("hash"))
    assert dedup.class_links(dedup.classes(df, "file", "hash").select("h")).count() < 100
    assert dedup.best_matches(df, "file", "hash").count() == dedup.hash_groups(df, "file", "hash").count() - 1


def test_split_parts_lose_no_pair():
    rnd = random.Random(2)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randrange(4)):
            b ^= 1 << bit
        for level in dedup._masks(3):
            assert any(a & m == b & m for m in level)
        top, below = dedup._masks(3)[:2]
        assert all(any(a & below[4 * i + j] == b & below[4 * i + j] for j in range(4)) for i, m in enumerate(top) if a & m == b & m)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "file long, hash long")
    assert dedup.hash_pairs(none, "file", "hash").count() == dedup.best_matches(none, "file", "hash").count() == dedup.hash_groups(none, "file", "hash").count() == 0
    twice = spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "file long, hash long")
    assert [tuple(r)[:2] for r in dedup.hash_pairs(twice, "file", "hash").collect()] == [(1, 2)]


def test_verified(spark):
    grey = np.random.default_rng(3).integers(0, 200, (4, 6)).astype(np.uint8)
    pictures = [(1, grey.tobytes(), 6, 4), (2, (grey + 20).tobytes(), 6, 4), (3, grey.tobytes()[:-1], 6, 4), (4, grey.tobytes(), 4, 6)]
    df = spark.createDataFrame(pictures, "file long, data binary, w int, h int")
    pairs = spark.createDataFrame([(1, 2, 0.97), (1, 3, 0.97), (1, 4, 0.97), (1, 9, 0.97), (1, 1, 0.95)], "id_1 long, id_2 long, similarity double")
    got = {r.id_2: r for r in dedup.verified(pairs, df, "file", "data", "w", "h").collect()}
    assert got[2].structural == pytest.approx(structural_similarity(grey, grey + 20)) and got[2].score == 0.97
    assert all(got[i].structural is None and got[i].score == 0.97 for i in (3, 4, 9)) and got[1].score == 1.0


@pytest.fixture(scope="module")
def pages(spark, sf):
    path = cluster.new_path(spark, "listing")
    listing.write_pages(_files(spark, sf), path, 20)
    return path


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_listing(spark, sf, pages):
    found = listing.images_of(listing.listing(spark, pages), 3)
    pushed = next(line for line in plan_of(found).splitlines() if line.startswith("PushedFilters"))
    assert all(x in pushed for x in ("In(mime", "EqualTo(parent,3)", "Not(EqualTo(trashed,true))")) and "Filter (" not in plan_of(found)
    want = _files(spark, sf).where("mime LIKE 'image/%' AND parent = 3 AND NOT coalesce(trashed, false)")
    assert sorted(r.file_id for r in found.collect()) == sorted(r.file_id for r in want.select("file_id").collect())
    others = listing.listing(spark, pages).where(F.col("name").startswith("IMG_1") & (F.col("size") > 500) & F.col("parent").isin(1, 2))
    want = _files(spark, sf).where("name LIKE 'IMG\\_1%' AND size > 500 AND parent IN (1, 2)")
    assert others.count() == want.count()


def test_pages_not_asked_for_are_not_read(spark, pages, tmp_path):
    import glob
    import shutil

    own = str(tmp_path / "pages")
    shutil.copytree(pages, own)
    for f in glob.glob(f"{own}/parent=4/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"broken")
    some = listing.listing(spark, own).where("parent = 3")
    assert some.count() > 0 and some.rdd.getNumPartitions() == len(glob.glob(f"{own}/parent=3/*.parquet"))
    with pytest.raises(Exception):  # noqa: B017
        listing.listing(spark, own).where("parent = 4").count()


def test_only_given_columns_are_read(spark, pages):
    few = listing.listing(spark, pages, "file_id long, parent long")
    assert few.columns == ["file_id", "parent"] and few.count() == listing.listing(spark, pages).count()
    assert "digest" not in plan_of(few)
