"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Statistics of each text are transformed into a vector. Per language and source, its location and
scatter are estimated by minimum covariance determinant. From each of several starts (medians and median absolute deviations,
medians alone, mean and covariance of all rows), concentration steps take mean and covariance of the share ``KEEP``
of rows with the smallest Mahalanobis distances, again and again; the start whose covariance ends with the least determinant is kept,
and its covariance made consistent by a factor. Rows at a squared distance over ``CUTOFF`` are rejected.

Distances are counted in bins, with the moments of each bin beside the counts, so that one grouped
sum over the rows does one concentration step: the bins up to the wanted share are added up. Nothing
but a row for each group and bin is ever brought together, however many rows a source has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import GAP, let, text_of
from .shared import stored

#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of rows that an estimate rests on, concentration steps, and least rows of a group; smaller
#: groups are judged by their language's estimate, then by that of all rows, or not at all.
KEEP, STEPS, LEAST_ROWS = 0.75, 4, 100
#: Squared distance from which a row is an outlier: the 0.999 quantile of chi-square, 4 degrees.
CUTOFF = 18.467
#: Statistics and the standard deviation that is added to their scatter: most texts have no symbols or repeats
#: at all, so scatter alone would reject every text that has any.
DIMENSIONS = {"x_symbol": 0.1, "x_line": 0.1, "x_repeat": 0.1, "x_word": 0.02}
#: The last of them is a mean over words, so a text's own share of its variance is this by the number of its words.
WORD_VARIANCE = 0.5
STARTS = 3
_X = list(DIMENSIONS)
_PAIRS = list(combinations_with_replacement(range(len(_X)), 2))
_GROUP = ["level", "g_lang", "g_source"]
_START = [*_GROUP, "start"]
_LAST = len(_X) - 1


def statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), and the row itself if asked."""
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if whole else []
    text = text_of(text_col)
    words = F.array_remove(F.split(text, GAP, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def repeated(windows: Column) -> Column:
        """Words in windows that occur again: the union of their places, three words each."""

        def places(s: Column) -> Column:
            return F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: F.coalesce(F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            )

        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        where = let(ranked, lambda s: let(places(s), lambda p: F.array_sort(F.transform(p, lambda i: F.get(s, i)["i"]))))
        covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(where, covered)).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def repeat_words(h: Column) -> Column:
        return F.when(F.size(h) >= 4, let(windows(h), repeated)).otherwise(0)

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def word_counts(w: Column) -> Column:
        chars = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).alias("n"), chars.alias("chars"), let(F.transform(w, lambda x: F.xxhash64(x)), repeat_words).alias("repeat"))

    found = df.select(
        *row, F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        let(words, word_counts).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, line_counts).alias("l"),
    )
    return found.select(
        *(["row"] if whole else []), "id", "lang", "source", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"), "n_symbols",
        F.col("l.n").cast("long").alias("n_lines"), F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.repeat").cast("long").alias("n_repeat_words"),
    )


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * n)
    whole = F.greatest(n, F.lit(1))
    return stats.select(
        "*", failed.alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / whole).alias("x_word"),
        F.sqrt(F.col("n_symbols") / whole).alias("x_symbol"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x_line"),
        F.sqrt(F.col("n_repeat_words") / whole).alias("x_repeat"),
    )


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in _GROUP))


def _of(level: Column) -> list[Column]:
    """The group of a row's language and source at a level: its source in its language, its language, or all."""
    return [level.cast("int").alias("level"), F.when(level > 0, F.col("lang")).alias("g_lang"), F.when(level > 1, F.col("source")).alias("g_source")]


def _groups(rows: DataFrame) -> DataFrame:
    """(lang, source, n, level, levels): the level that judges the rows, and those whose estimates rest on them."""
    fine = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    coarse = fine.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang")))
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("of_lang") >= LEAST_ROWS, 1).otherwise(0)
    placed = stored(coarse.select("lang", "source", "n", level.alias("level")), "quality-levels")
    needed = lambda k: F.max(F.col("level") == k).over(Window.partitionBy("lang"))
    everyone = F.lit(not placed.where("level = 0").isEmpty())
    levels = [F.when(F.col("level") == 2, 2), F.when(needed(1), 1), F.when(everyone, 0)]
    return stored(placed.withColumn("levels", F.array_compact(F.array(*levels))), "quality-groups")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows once for each group whose estimate rests on them."""
    a, b = rows.alias("a"), groups.select("lang", "source", F.explode("levels").alias("level")).alias("b")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", F.col("b.level").alias("level"))
    level = F.col("level")
    return joined.select("id", "n_words", *_X, *_of(level))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """The median of each value by group, to 1 / 256, from counts of bins."""
    cells = rows.select(*_GROUP, F.posexplode(F.array(*(F.floor(v * 256 + 0.5).cast("int") for v in values))).alias("d", "bin"))
    counts = cells.groupBy(*_GROUP, "d", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*_GROUP, "d")
    counts = counts.select("*", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("all"))
    middle = counts.where(F.col("upto") * 2 >= F.col("all")).groupBy(*_GROUP, "d").agg((F.min("bin") / 256.0).alias("m"))
    return middle.groupBy(*_GROUP).agg(*(F.max(F.when(F.col("d") == i, F.col("m"))).alias(f"m{i}") for i in range(len(values))))


def _factor() -> float:
    """What makes the covariance of the share ``KEEP`` of nearest normal rows that of all: chi-square, 4 and 6 degrees."""
    cdf = lambda x, terms: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(terms))
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, 2) < KEEP else (low, mid)
    return KEEP / cdf(low, 3)


def _root(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l<i><j> of the covariance c<i><j> plus the added variances; of its last diagonal element the square, ``rest``."""
    p = len(_X)
    for j in range(p):
        for i in range(j, p):
            least = F.lit(DIMENSIONS[_X[i]] ** 2)
            left = F.col(f"c{j}{i}") + (least if i == j else F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j == _LAST:
                params = params.withColumn("rest", F.greatest(left, least))
            else:
                params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, least)) if i == j else left / F.col(f"l{j}{j}"))
    return params


def _substitute(i: int, x: str) -> Callable[[Column], Column]:
    def add(z: Column) -> Column:
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.get(z, F.lit(k))
        of_text = F.lit(WORD_VARIANCE) / F.greatest(F.col("n_words"), F.lit(1))
        return F.concat(z, F.array(rest / (F.sqrt(F.col("rest") + of_text) if i == _LAST else F.col(f"l{i}{i}"))))

    return add


def _distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution, each step computed once."""
    state = F.array().cast("array<double>")
    for i, x in enumerate(_X):
        state = let(state, _substitute(i, x))
    return F.aggregate(state, F.lit(0.0), lambda a, z: a + z * z)


def _judged(rows: DataFrame, params: DataFrame) -> DataFrame:
    own = [c for c in params.columns if c not in _GROUP]
    joined = rows.alias("a").join(params.alias("b"), _same("a", "b"), "left").select("a.*", *(f"b.{c}" for c in own))
    return joined.withColumn("d2", _distance()).drop(*(c for c in own if c != "start"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of the values and of their products."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)), *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]
    return rows.groupBy(*keys).agg(*sums)


def _scatter(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and covariance, times a factor, from the moments."""
    mean = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(_X))]
    cov = [(F.lit(factor) * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n"))).alias(f"c{i}{j}") for i, j in _PAIRS]
    return sums.select(*keys, *mean, *cov)


def _starts(rows: DataFrame) -> DataFrame:
    middle = stored(_medians(rows, [F.col(x) for x in _X]), "quality-medians")
    near = rows.alias("a").join(middle.alias("b"), _same("a", "b")).select("a.*", *(f"m{i}" for i in range(len(_X))))
    spread = _medians(near, [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(_X)])
    spread = spread.select(*_GROUP, *((F.col(f"m{i}") * 1.4826).alias(f"s{i}") for i in range(len(_X))))
    both = middle.alias("a").join(spread.alias("b"), _same("a", "b")).select("a.*", *(f"b.s{i}" for i in range(len(_X))))
    at = [f"m{i}" for i in range(len(_X))]
    diagonal = [(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    first = both.select(F.lit(0).alias("start"), *_GROUP, *at, *diagonal)
    second = middle.select(F.lit(1).alias("start"), *_GROUP, *at, *(F.lit(0.0).alias(f"c{i}{j}") for i, j in _PAIRS))
    third = _scatter(_moments(rows, _GROUP), _GROUP, 1.0).withColumn("start", F.lit(2))
    return first.unionByName(second).unionByName(third)


def estimate(rows: DataFrame) -> DataFrame:
    """A row for each group: location m0.., covariance c00.. and its factor l00..: the MCD estimate."""
    params = stored(_root(_starts(rows)), "quality-start")
    for _ in range(STEPS):
        held = _judged(rows, params).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 16).cast("int"))
        bins = _moments(held, [*_START, "bin"])
        own = Window.partitionBy(*_START)
        bins = bins.select("*", (F.sum("n").over(own.orderBy("bin")) - F.col("n")).alias("under"), F.sum("n").over(own).alias("all"))
        added = [F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(len(_X))), *(f"q{i}{j}" for i, j in _PAIRS))]
        kept = bins.where(F.col("under") < F.ceil(F.col("all") * KEEP)).groupBy(*_START).agg(*added)
        params = stored(_root(_scatter(kept, _START, _factor())), "quality-step")
    determinant = F.log("rest") + sum(2 * F.log(f"l{i}{i}") for i in range(_LAST))
    values = [c for c in params.columns if c not in _START]
    best = F.min_by(F.struct(*values), F.struct(F.round(determinant, 9), "start")).alias("best")
    return stored(params.groupBy(*_GROUP).agg(best).select(*_GROUP, "best.*"), "quality-best")


def _decided(rows: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Adds distance and kept to the vectors of all rows, or of ``judged``, the same rows with more columns."""
    sound = rows.where(~F.col("base_failed"))
    known = _groups(sound)
    enough = F.lit((known.agg(F.sum("n")).head()[0] or 0) >= LEAST_ROWS)
    params = estimate(stored(_grouped(sound.select("id", "lang", "source", "n_words", *_X), known), "quality-sound"))
    groups = known.select("lang", "source", *_of(F.col("level")))
    a, b = (judged or rows).alias("a"), groups.alias("b")
    placed = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", *(f"b.{c}" for c in _GROUP))
    far = enough & (F.coalesce("d2", F.lit(0.0)) > CUTOFF)
    return _judged(placed, params).withColumns({"distance": F.when(~F.col("base_failed"), F.round("d2", 6)), "kept": ~F.col("base_failed") & ~far})


def judge(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Returns (``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    Null and empty texts have no words and fail. Null languages and sources are groups like others.
    Estimates rest on all rows that pass the base rules; a group of fewer than ``LEAST_ROWS`` such rows
    is judged by the estimate of all rows of its language, then by that of all rows; if those are fewer too, nothing more is rejected.
    Equal rows are judged alike, other columns are ignored, an empty table gives no rows.
    """
    done = _decided(stored(_vectors(statistics(df, id_col, text_col, lang_col, source_col)), "quality-stats"))
    return done.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns.

    Estimates are made of the statistics alone, which are narrow; then each row's own are made again where it is read, and judged there. So no text is
    shuffled nor written.
    """
    narrow = stored(_vectors(statistics(df, id_col, text_col, lang_col, source_col)), "quality-stats")
    whole = _vectors(statistics(df, id_col, text_col, lang_col, source_col, whole=True))
    return _decided(narrow, whole).where("kept").select("row.*")
