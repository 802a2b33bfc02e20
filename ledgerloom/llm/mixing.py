"""Mixing of sources to target weights, as a curriculum over training time.

Targets: sources in code point order, null last, weigh ``WEIGHTS`` in turn and share all words; a
target stops at ``MOST`` times its source's size and the excess is shared by weight among the others.
Stream: the documents of a source follow each other in a hashed order, pass after pass, until the
target is reached; the last document taken may be taken in part, so that targets are met to a word.
Curriculum: the weight of a source changes over time; its integral is the source's cumulative demand
D(t), and the copy of a document that starts at word c of the stream is trained at t with D(t) = c.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import word_count
from .shared import stored

#: Fixed values of the mix: weights in turn, and the most times that a source's words are taken.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Schedules in turn: weight at the start and at the end of training, linear between.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: Parts of the hashed order of a source that are summed apart.
CELL_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target, start, end. One row for each source.

    The level at which a target per weight settles: among sources in order of their limit per weight,
    the first whose share, when all before it have stopped at their limits, is within its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.select("source", "source_size", "i", pick(WEIGHTS, F.col("i")).alias("w"), (F.lit(MOST) * F.col("source_size")).alias("most"))
    by_limit = Window.orderBy(F.col("most") / F.col("w"), "i")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    settled = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct((F.col("most") / F.col("w")).alias("limit"), "i", "level"))).over(every)
    starts, ends = zip(*SCHEDULES)
    return leveled.withColumn("settled", settled["level"]).select(
        "source", "source_size",
        F.least(F.col("most").cast("double"), F.coalesce(F.col("settled"), F.lit(0.0)) * F.col("w")).alias("target"),
        pick(starts, F.col("i")).alias("start"), pick(ends, F.col("i")).alias("end"),
    )


def _time(done: Column, start: Column, end: Column) -> Column:
    """t with (start t + (end - start) t^2 / 2) / ((start + end) / 2) = done."""
    slope = end - start
    root = F.sqrt(start * start + slope * (start + end) * done)
    return F.when(slope == 0, done).otherwise((root - start) / slope)


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = 0) -> DataFrame:
    """Returns (``id_col``, size, source, source_size, target, taken, positions) of every row.

    ``size`` counts words (null text: 0), ``taken`` the words that the mix takes, repeats counted, at
    most ``MOST`` times the size. ``positions`` are the training times in [0, 1) of each copy taken, in
    part or whole; empty if none is. A null source is a source. Rows with equal ids follow each other by
    size; rows equal in both are alike. An empty table gives no rows. Reruns agree for a ``seed``.

    A source's stream is summed in cells of its hashed order, so a source with most of the rows is
    spread over many tasks; only one row for each source is ever ranked in a single task.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = stored(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
            key.alias("key"),
        ).withColumn("cell", F.substring("key", 1, CELL_DIGITS)),
        "mix-rows",
    )
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    of = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("source", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    a, b = firsts.alias("a"), of.alias("b")
    params = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "cell", "first", "source_size", "target", "start", "end")
    params = stored(params, "mix-params")
    r, p = rows.alias("r"), params.alias("p")
    joined = r.join(p, (F.col("r.cell") == F.col("p.cell")) & F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.id", "r.source", "r.size", "r.key", "r.cell", "first", "source_size", "target", "start", "end"
    )
    running = Window.partitionBy("cell", "source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = joined.withColumn("at", F.col("first") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    goal = F.floor("target").cast("long")
    offset = [F.col("at") + k * F.col("source_size") for k in range(MOST)]
    part = [F.greatest(F.lit(0), F.least(F.col("size"), goal - c)) for c in offset]
    times = [F.when(n > 0, _time(c / F.col("target"), F.col("start"), F.col("end"))) for n, c in zip(part, offset)]
    return at.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", sum(part[1:], part[0]).alias("taken"), F.array_compact(F.array(*times)).alias("positions")
    )


def by_position(mixed: DataFrame, *ties: str) -> DataFrame:
    """Documents in the order of their first training position, those not taken last: a range sort."""
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    at = stored(mixed.withColumn("position", first), "mix-order")  # what is sampled for ranges is read, not made twice
    parts = max(1, int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return at.repartitionByRange(parts, "position", *ties).sortWithinPartitions("position", *ties)
