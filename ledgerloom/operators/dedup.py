"""Duplicates: equal contents, hashes within a distance, their best matches and the groups that they form.

Ids of equal hashes are one class. Classes meet in joins and carry their smallest id; ids are only joined to their class, so a hash that
half of all rows share costs what its rows cost. ``hash_pairs`` alone lists pairs of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.cluster import shared_dir, ship
from ledgerloom.functions.hashing import BITS, distance, similarity
from ledgerloom.functions.images import structural_similarity

#: A part of a hash that more than so many different hashes share is split by further bits, as often as given.
HOT, LEVELS = 256, 3


def _masks(most: int) -> list[list[int]]:
    """For each level the bits that must be equal, ``most`` + 1 masks below each of the level before.

    Of the bits that a mask leaves free, two hashes at most ``most`` bits apart agree in one of ``most`` + 1 parts.
    """
    levels, n = [[0]], most + 1
    for _ in range(LEVELS):
        below = []
        for mask in levels[-1]:
            free = [b for b in range(BITS) if not mask >> b & 1]
            below += [mask | sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]
        levels.append(below)
    return levels[1:]


def classes(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(h, first_id, n) of every hash; rows without one are in none."""
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("h IS NOT NULL AND id IS NOT NULL")
    return rows.groupBy("h").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("n"))


def class_links(found: DataFrame, most: int = 3) -> DataFrame:
    """(h1, h2) of different hashes at most ``most`` bits apart, h1 < h2.

    Hashes meet where they agree in a part. Where too many do, they meet by that part and a part of the other bits instead, which loses no pair.
    """
    n, met, level = most + 1, [], found.select("h", F.lit(0).alias("mask"))
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    for depth, masks in enumerate(_masks(most)):
        bits = F.array(*(F.lit(signed(m)).cast("bigint") for m in masks))
        level = level.select("h", F.explode(F.sequence(F.col("mask") * n, F.col("mask") * n + most)).alias("mask"))
        level = level.select("h", "mask", F.col("h").bitwiseAND(F.get(bits, F.col("mask"))).alias("part"))
        last = depth == LEVELS - 1
        sizes = level.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = level.join(sizes, ["mask", "part"])
        met.append((sized if last else sized.where(F.col("size") <= HOT)).select("h", F.lit(depth).alias("depth"), "mask", "part"))
        if last:
            break
        level = sized.where(F.col("size") > HOT).select("h", "mask")
    rows = met[0]
    for more in met[1:]:
        rows = rows.unionByName(more)
    one, two = rows.withColumnRenamed("h", "h1"), rows.withColumnRenamed("h", "h2")
    near = one.join(two, ["depth", "mask", "part"]).where((F.col("h1") < F.col("h2")) & (distance(F.col("h1"), F.col("h2")) <= most))
    return near.select("h1", "h2").distinct()


def hash_pairs(df: DataFrame, id_col: str, hash_col: str, most: int = 3) -> DataFrame:
    """(id_1, id_2, similarity) of all pairs of ids whose hashes are at most ``most`` bits apart, id_1 < id_2."""
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("h IS NOT NULL AND id IS NOT NULL").distinct()
    near = class_links(rows.select("h").distinct(), most)
    near = near.union(rows.groupBy("h").count().where("count > 1").select("h", "h"))
    one, two = rows.select(F.col("h").alias("h1"), F.col("id").alias("a")), rows.select(F.col("h").alias("h2"), F.col("id").alias("b"))
    pairs = near.join(one, "h1").join(two, "h2").where("a <> b AND (h1 <> h2 OR a < b)")
    return pairs.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), similarity(F.col("h1"), F.col("h2")).alias("similarity"))


def best_matches(df: DataFrame, id_col: str, hash_col: str, most: int = 3) -> DataFrame:
    """(id, match_id, similarity): the most similar smaller id, of equally similar ones the smallest; no row without one. Ids are unique.

    An id that isn't the first of its class has that one; a first id has the first ids of near classes.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("h IS NOT NULL AND id IS NOT NULL")
    found = checkpointed(classes(df, id_col, hash_col))
    own = rows.join(found, "h").where("id > first_id").select("id", F.col("first_id").alias("match_id"), F.lit(1.0).alias("similarity"))
    links = class_links(found.select("h"), most)
    both = links.union(links.select("h2", "h1"))
    of = lambda h, name: found.select(F.col("h").alias(h), F.col("first_id").alias(name))
    near = both.join(of("h1", "id"), "h1").join(of("h2", "match_id"), "h2").where("match_id < id")
    best = near.groupBy("id").agg(F.max(F.struct(similarity(F.col("h1"), F.col("h2")).alias("s"), (-F.col("match_id")).alias("m"))).alias("x"))
    return own.unionByName(best.select("id", (-F.col("x.m")).alias("match_id"), F.col("x.s").alias("similarity")))


def hash_groups(df: DataFrame, id_col: str, hash_col: str, most: int = 3) -> DataFrame:
    """(id, group_id) of ids with a duplicate: the smallest id that is reachable. Classes are grouped, members follow theirs."""
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).where("h IS NOT NULL AND id IS NOT NULL").distinct()
    found = checkpointed(classes(df, id_col, hash_col))
    of = lambda h, name: found.select(F.col("h").alias(h), F.col("first_id").alias(name))
    links = class_links(found.select("h"), most).join(of("h1", "id_1"), "h1").join(of("h2", "id_2"), "h2").select("id_1", "id_2")
    # an id may be the first of several classes
    reached = groups(links.where("id_1 <> id_2").union(rows.join(found, "h").where("id <> first_id").select("first_id", "id")))
    return rows.select("id").distinct().join(reached, "id")


def verified(pairs: DataFrame, pictures: DataFrame, id_col: str, data: str, width: str, height: str) -> DataFrame:
    """Adds structural similarity to candidates (id_1, id_2, similarity): ``structural``, and ``score``, the larger of both.

    Pictures of different sizes, and those whose bytes don't fit or lack, have none and keep the similarity of their hashes. Candidates alone fetch
    pictures, a batch of pairs at a time.
    """
    ship(pairs.sparkSession)
    side = lambda n: pictures.select(F.col(id_col).alias(f"id_{n}"), F.col(data).alias(f"d{n}"), F.col(width).alias(f"w{n}"), F.col(height).alias(f"h{n}"))
    rows = pairs.select("id_1", "id_2", "similarity").join(side(1), "id_1", "left").join(side(2), "id_2", "left")
    kind = pairs.schema["id_1"].dataType.simpleString()

    def grey(d: bytes | None, w: int | None, h: int | None) -> np.ndarray | None:
        return np.frombuffer(d, np.uint8).reshape(h, w) if d and w and h and len(d) == w * h else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("d1", "w1", "h1", "d2", "w2", "h2"))):
                a, b = grey(*r[:3]), grey(*r[3:])
                out.append(structural_similarity(a, b) if a is not None and b is not None and a.shape == b.shape else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id_1", "id_2", "similarity")), pa.array(out, pa.float64())], ["id_1", "id_2", "similarity", "structural"])

    done = rows.mapInArrow(compare, f"id_1 {kind}, id_2 {kind}, similarity double, structural double")
    return done.withColumn("score", F.greatest("similarity", "structural"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that is reachable over pairs, by labels that jump to their labels."""
    both = checkpointed(pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).union(pairs.select("id_2", "id_1")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("group_id")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("other"))
        least = labels.join(near, "id").select("id", F.col("group_id").alias("was"), F.least("group_id", "other").alias("group_id"))
        roots = labels.select(F.col("id").alias("group_id"), F.col("group_id").alias("root"))
        new = checkpointed(least.join(roots, "group_id").select("id", "was", F.least("group_id", "root").alias("group_id")))
        if new.where("was <> group_id").isEmpty():
            return new.select("id", "group_id")
        labels = new.select("id", "group_id")


def first_of_content(df: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """Adds the smallest id with the same content: a grouped minimum joined back, so a common content is no single task."""
    firsts = df.groupBy(digest_col).agg(F.min(id_col).alias("original_id"))
    return df.join(firsts, digest_col)


def cached_anti(new: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return new.join(cached, key, "left_anti")
