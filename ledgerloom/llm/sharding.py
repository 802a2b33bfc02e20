"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups (documents of equal text) stay together. A group with over 1 / ``CELLS`` of all bytes, tokens or
rows is a unit of its own, of which there can be at most 3 * ``CELLS``; one of over half a shard is cut
into pieces by document id. All other groups are dealt by hash into ``CELLS`` units. The driver thus
places a bounded number of units, largest first, each into the shard where the dot product of its
vector with the shard's residual capacity is highest; then single units are
exchanged between the fullest and the emptiest shard while their bytes come closer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Bound of the units of small groups; units of large ones are at most three times as many, plus pieces.
CELLS = 4096
#: Rows that one task numbers, about.
NUMBERED = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def place(units: np.ndarray, n_shards: int) -> list[int]:
    """The shard of each unit (a row of the dimensions' sizes)."""
    total = units.sum(axis=0)
    share = units / np.where(total > 0, total, 1) * n_shards
    left = np.ones((n_shards, units.shape[1]))
    out = [0] * len(units)
    for i in np.lexsort((np.arange(len(units)), -share.max(axis=1))) if len(units) else []:
        out[i] = best = int(np.argmax(left @ share[i]))
        left[best] -= share[i]
    return _evened(np.array(out, int), share if len(units) else units, n_shards)


def _evened(at: np.ndarray, share: np.ndarray, n_shards: int) -> list[int]:
    """Exchanges units between the fullest and the emptiest shard by bytes while that brings them closer."""
    load = np.bincount(at, share[:, 0], n_shards) if len(at) else np.zeros(n_shards)
    for _ in range(50 * n_shards):
        a, b = int(load.argmax()), int(load.argmin())
        more, less = np.flatnonzero(at == a), np.flatnonzero(at == b)
        if a == b or not len(more) or not len(less):
            break
        less = less[np.argsort(share[less, 0], kind="stable")]
        gap = load[a] - load[b]
        near = np.searchsorted(share[less, 0], share[more, 0] - gap / 2)
        pairs = np.stack([np.tile(more, 2), less[np.clip(np.concatenate((near - 1, near)), 0, len(less) - 1)]], axis=1)
        moved = share[pairs[:, 0]] - share[pairs[:, 1]]
        cost = np.abs(gap - 2 * moved[:, 0]) + np.abs(moved[:, 2])
        k = int(cost.argmin())
        if cost[k] >= gap * 0.999:
            break
        (i, j), step = pairs[k], moved[k, 0]
        at[i], at[j] = b, a
        load[a], load[b] = load[a] - step, load[b] + step
    return at.tolist()


def shard(df: DataFrame, id_col: str, text_col: str, n_shards: int = 8) -> DataFrame:
    """Returns (``id_col``, size, text_crc32, shard, slot) of every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Law: sizes of shards are near equal; so are
    counts of words and rows, as far as groups allow. Slots count from 0 in each shard without a
    gap, in the order of hash chunks, then ids; equal rows get different slots. Null and empty
    texts are one group. Other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "shard-rows",
    )
    key = ["group", "text_crc32", "size"]
    groups = stored(rows.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")), "shard-groups")
    total = [x or 0 for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).head()]
    top = F.greatest(*(F.col(c) / F.lit(float(max(n, 1))) for c, n in zip("btr", total)))
    sized = groups.select(*key, "b", "t", "r", top.alias("top"), F.pmod("group", F.lit(CELLS)).cast("int").alias("cell"))
    large = sized.where(F.col("top") > 1 / CELLS).orderBy(*key).collect()
    cells = sized.where(F.col("top") <= 1 / CELLS).groupBy("cell").agg(F.sum("b"), F.sum("t"), F.sum("r")).orderBy("cell").collect()
    pieces = [max(1, int(np.ceil(g.top * n_shards / 0.25))) if g.top * n_shards > 0.5 else 1 for g in large]
    units = [[v / n for v in (g.b, g.t, g.r)] for g, n in zip(large, pieces) for _ in range(n)] + [list(c)[1:] for c in cells]
    at = place(np.array(units, float).reshape(-1, 3), n_shards)
    ends = np.cumsum([0, *pieces]).tolist()
    of_large = spark.createDataFrame([(*(g[c] for c in key), at[a:b]) for g, a, b in zip(large, ends, ends[1:])], "`group` long, text_crc32 long, size long, own array<int>")
    of_cells = spark.createDataFrame([(c.cell, s) for c, s in zip(cells, at[ends[-1] :])], "cell int, shard int")

    chunks = max(32, -(-total[2] // (NUMBERED * n_shards)))
    dealt = (
        rows.withColumn("cell", F.pmod("group", F.lit(CELLS)).cast("int"))
        .join(F.broadcast(of_large), key, "left")
        .join(F.broadcast(of_cells), "cell", "left")
        .withColumn("hash", F.xxhash64(F.lit(7), "id"))
        .select(
            "id", "size", "text_crc32",
            F.when(F.col("own").isNotNull(), F.get("own", F.pmod("hash", F.size("own")).cast("int"))).otherwise(F.col("shard")).alias("shard"),
            F.pmod("hash", F.lit(chunks)).alias("chunk"),
        )
    )
    counts = dealt.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("id", "size", "text_crc32")
    return dealt.join(firsts, ["shard", "chunk"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(within) - 1).alias("slot")
    )
