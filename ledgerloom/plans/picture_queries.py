"""Queries of picture steps: (Spark plan, DuckDB SQL over pixels). Pictures are made of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import images
from ledgerloom.functions import pictures as P
from ledgerloom.operators import pictures
from ledgerloom.sources.pictures import SIDE, from_vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Lines of a picture of 64 by 64 have fewer edge pixels than those of a page.
VOTES, SMALL = 24, 32

#: Pixels (picture_id, y, x, g) and heights.
PIXELS = f"""
  pv AS (SELECT vec_id // {SIDE} AS picture_id, row_number() OVER (PARTITION BY vec_id // {SIDE} ORDER BY vec_id) - 1 AS y, embedding FROM embeddings WHERE len(embedding) = {SIDE}),
  px AS MATERIALIZED (SELECT picture_id, y, i - 1 AS x, greatest(0, least(255, floor(embedding[i]::DOUBLE * 256) + 128))::BIGINT AS g FROM pv, range(1, {SIDE + 1}) t(i)),
  ph AS (SELECT picture_id, max(y) + 1 AS h, {SIDE} AS w FROM px GROUP BY 1)"""
_SHOWN = "SELECT picture_id, max(x)::INT + 1 AS made_width, max(y)::INT + 1 AS made_height, md5(string_agg(printf('%02X', v::INT), '' ORDER BY y, x)) AS made_md5, NULL::VARCHAR AS failed_step FROM {} GROUP BY picture_id"


def _shown(done: DataFrame) -> DataFrame:
    return done.select("picture_id", "made_width", "made_height", F.md5(F.hex("made")).alias("made_md5"), "failed_step")


def add(name: str, steps: tuple[str, ...], text: str | None = None, options: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _shown(pictures.preprocessed(from_vectors(spark, sf_dir), steps=steps, options=options))
    if text:
        SQL[name] = f"WITH {PIXELS}, {text.strip()}"


add(
    "img_resize", ("resize",),
    f"""e AS (SELECT picture_id, h, w, (h * least(1.0::DOUBLE, {SMALL}::DOUBLE / greatest(h, w)))::INT AS nh, {SMALL} AS nw FROM (SELECT picture_id, h::DOUBLE AS h, w::DOUBLE AS w FROM ph)),
    o AS (SELECT picture_id, floor(j) AS j, floor(i) AS i, g * greatest(0, least((j + 1) * h / nh, y + 1) - greatest(j * h / nh, y)) / (h / nh) * greatest(0, least((i + 1) * w / nw, x + 1) - greatest(i * w / nw, x)) / (w / nw) AS part
      FROM (SELECT p.*, e.h, e.w, e.nh, e.nw, a.j, b.i FROM px p JOIN e USING (picture_id), range({SMALL}) a(j), range({SMALL}) b(i)
        WHERE j < nh AND (j + 1) * h / nh > y AND j * h / nh < y + 1 AND (i + 1) * w / nw > x AND i * w / nw < x + 1)),
    s AS (SELECT picture_id, j AS y, i AS x, floor(sum(part) + 0.5) AS v FROM o GROUP BY ALL)
    """ + _SHOWN.format("s"), {"resize": {"side": SMALL}},
)
_around = lambda i, n: f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END)"
add(
    "img_sharpen", ("sharpen",),
    f"""n AS (SELECT p.picture_id, p.y, p.x, p.g, {_around('p.y + dy', 'h')} AS ny, {_around('p.x + dx', 'w')} AS nx FROM px p JOIN ph USING (picture_id), range(-1, 2) a(dy), range(-1, 2) b(dx)),
    s AS (SELECT n.picture_id, n.y, n.x, greatest(0, least(255, 10 * any_value(n.g) - sum(q.g))) AS v FROM n JOIN px q ON q.picture_id = n.picture_id AND q.y = ny AND q.x = nx GROUP BY n.picture_id, n.y, n.x)
    """ + _SHOWN.format("s"),
)
_T = P.TILES
add(
    "img_contrast", ("contrast",),
    f"""e AS (SELECT *, (h + {_T - 1}) // {_T} AS th, (w + {_T - 1}) // {_T} AS tw FROM ph),
    c AS (SELECT e.picture_id, r.y // th AS ty, s.x // tw AS tx, g, count(*) AS n, any_value(th * tw) AS area FROM e, range(0, 2 * {SIDE}) r(y), range(0, 2 * {SIDE}) s(x), px
      WHERE r.y < th * {_T} AND s.x < tw * {_T} AND px.picture_id = e.picture_id AND px.y = {_around('r.y', 'h')} AND px.x = {_around('s.x', 'w')} GROUP BY ALL),
    t AS (SELECT picture_id, ty, tx, any_value(area) AS area, greatest(1, floor({P.CLIP} * any_value(area) / 256)::BIGINT) AS most FROM c GROUP BY ALL),
    o AS (SELECT t.picture_id, t.ty, t.tx, t.area, t.most, sum(greatest(n - most, 0))::BIGINT AS over FROM c JOIN t USING (picture_id, ty, tx) GROUP BY ALL),
    b AS (SELECT o.picture_id, o.ty, o.tx, o.area, v, least(coalesce(n, 0), most) + over // 256
      + CASE WHEN over % 256 > 0 AND v % greatest(1, 256 // greatest(over % 256, 1)) = 0 AND v // greatest(1, 256 // greatest(over % 256, 1)) < over % 256 THEN 1 ELSE 0 END AS n
      FROM (SELECT * FROM o, range(256) t(v)) o LEFT JOIN c ON c.picture_id = o.picture_id AND c.ty = o.ty AND c.tx = o.tx AND c.g = v),
    m AS MATERIALIZED (SELECT picture_id, ty, tx, v, least(255, floor((sum(n) OVER (PARTITION BY picture_id, ty, tx ORDER BY v))::DOUBLE * (255.0::DOUBLE / area::DOUBLE) + 0.5::DOUBLE)) AS to_ FROM b),
    k AS (SELECT p.*, floor(y::DOUBLE / th::DOUBLE - 0.5) AS y0, floor(x::DOUBLE / tw::DOUBLE - 0.5) AS x0, y::DOUBLE / th::DOUBLE - 0.5::DOUBLE AS fy, x::DOUBLE / tw::DOUBLE - 0.5::DOUBLE AS fx FROM px p JOIN e USING (picture_id)),
    q AS (SELECT *, greatest(0, y0) AS t, least({_T - 1}, y0 + 1) AS d, greatest(0, x0) AS l, least({_T - 1}, x0 + 1) AS r, fy - y0 AS a, fx - x0 AS b FROM k),
    s AS (SELECT q.picture_id, y, x, greatest(0, least(255, floor((tl.to_ * (1 - b) + tr.to_ * b) * (1 - a) + (bl.to_ * (1 - b) + br.to_ * b) * a + 0.5))) AS v FROM q
      JOIN m tl ON tl.picture_id = q.picture_id AND tl.ty = t AND tl.tx = l AND tl.v = g JOIN m tr ON tr.picture_id = q.picture_id AND tr.ty = t AND tr.tx = r AND tr.v = g
      JOIN m bl ON bl.picture_id = q.picture_id AND bl.ty = d AND bl.tx = l AND bl.v = g JOIN m br ON br.picture_id = q.picture_id AND br.ty = d AND br.tx = r AND br.v = g)
    """ + _SHOWN.format("s"),
)
add("img_denoise", ("denoise",))
add("img_deskew", ("deskew",), options={"deskew": {"votes": VOTES}})


def _blurred(source: str, value: str, sigma: float, radius: int) -> str:
    """(picture_id, y, x, v): a separable Gaussian blur of ``value``, borders mirrored, to the nearest whole number."""
    weight = f"exp(-(d * d)::DOUBLE / {2 * sigma * sigma}::DOUBLE) / (SELECT sum(exp(-(j * j)::DOUBLE / {2 * sigma * sigma}::DOUBLE)) FROM range(-{radius}, {radius + 1}) t(j))"
    at = lambda axis, n: f"""SELECT a.picture_id, a.y, a.x, sum({weight} * b.{'v' if axis == 'x' else value}) AS v FROM (SELECT * FROM {source} JOIN ph USING (picture_id), range(-{radius}, {radius + 1}) t(d)) a
      JOIN {'bv' if axis == 'x' else source} b ON b.picture_id = a.picture_id AND b.y = {_around('a.y + a.d', 'h') if axis == 'y' else 'a.y'} AND b.x = {_around('a.x + a.d', 'w') if axis == 'x' else 'a.x'} GROUP BY a.picture_id, a.y, a.x"""  # noqa: E731
    return f"bv AS ({at('y', 'h')}), bw AS ({at('x', 'w')}), blur AS (SELECT picture_id, y, x, greatest(0, least(255, floor(v + 0.5::DOUBLE))) AS v FROM bw)"


_R, _S = P.BILATERAL // 2, 2 * P.SIGMA * P.SIGMA
add(
    "img_text_mask", ("text_mask",),
    f"""n AS (SELECT p.picture_id, p.y, p.x, p.g, dy * dy + dx * dx AS far, {_around('p.y + dy', 'h')} AS ny, {_around('p.x + dx', 'w')} AS nx FROM px p JOIN ph USING (picture_id), range(-{_R}, {_R + 1}) a(dy), range(-{_R}, {_R + 1}) b(dx) WHERE dy * dy + dx * dx <= {_R * _R}),
    k AS (SELECT n.picture_id, n.y, n.x, q.g, exp(-(far::DOUBLE / {_S}::DOUBLE) - ((q.g - n.g) * (q.g - n.g))::DOUBLE / {_S}::DOUBLE) AS k FROM n JOIN px q ON q.picture_id = n.picture_id AND q.y = ny AND q.x = nx),
    f AS MATERIALIZED (SELECT picture_id, y, x, floor(sum(k * g) / sum(k) + 0.5::DOUBLE) AS g FROM k GROUP BY ALL),
    {_blurred('f', 'g', 0.3 * ((P.BLOCK - 1) * 0.5 - 1) + 0.8, P.BLOCK // 2)},
    s AS (SELECT f.picture_id, f.y, f.x, CASE WHEN f.g > blur.v - {P.OFFSET} THEN 255 ELSE 0 END AS v FROM f JOIN blur USING (picture_id, y, x))
    """ + _SHOWN.format("s"),
)
add(
    "img_ocr_enhance", ("ocr_enhance",),
    f"""m AS (SELECT picture_id, floor(avg(g) + 0.5::DOUBLE) AS mean FROM px GROUP BY 1),
    o AS MATERIALIZED (SELECT picture_id, y, x, greatest(0, least(255, trunc(mean + {P.CONTRAST}::DOUBLE * (g - mean)))) AS v FROM px JOIN m USING (picture_id)),
    n AS (SELECT a.picture_id, a.y, a.x, sum(b.v) AS nine, count(*) AS n FROM o a JOIN o b ON b.picture_id = a.picture_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL),
    e AS (SELECT o.*, CASE WHEN n = 9 THEN floor((nine + 4 * v) / 13 + 0.5::DOUBLE) ELSE v END AS smooth FROM o JOIN n USING (picture_id, y, x)),
    u AS MATERIALIZED (SELECT picture_id, y, x, greatest(0, least(255, trunc(smooth + {P.SHARPNESS}::DOUBLE * (v - smooth)))) AS g FROM e),
    {_blurred('u', 'g', P.RADIUS, 3 * int(-(-P.RADIUS // 1)))},
    s AS (SELECT u.picture_id, u.y, u.x, greatest(0, least(255, CASE WHEN abs(g - blur.v) > {P.THRESHOLD} THEN g + trunc((g - blur.v) * {P.PERCENT} / 100) ELSE g END)) AS v FROM u JOIN blur USING (picture_id, y, x))
    """ + _SHOWN.format("s"),
)


def misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of which some can't be loaded: no bytes where the id is 1 past a multiple of 5, a wrong width where it is 3 past."""
    i = F.col("picture_id") % 5
    return from_vectors(spark, sf_dir).withColumns({"data": F.when(i != 1, F.col("data")), "width": F.when(i == 3, F.col("width") + 1).otherwise(F.col("width"))})


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pictures.preprocessed(misfits(spark, sf_dir), options={"resize": {"side": SMALL}, "deskew": {"votes": VOTES}}, measure=True)
    measured = [F.round(f"quality.{c}", 5).alias(c) for c in ("sharpness", "brightness", "contrast")]
    return done.select("picture_id", "made_width", "made_height", F.md5(F.hex("made")).alias("made_md5"), "failed_step", "step_error", *measured)


QUERIES["img_preprocess"] = _chain


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = misfits(spark, sf_dir)
    of = (F.col("data"), F.col("width"), F.col("height"))
    q = images.quality_column(*of)
    return x.select("picture_id", *(images.hash_column(*of, kind=k).alias(k) for k in images.HASHES), F.round(q["sharpness"], 5).alias("sharpness"), q["total_pixels"].alias("total_pixels"))


QUERIES["img_hashes"] = _hashes
