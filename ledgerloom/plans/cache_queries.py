"""Queries of sources, recognition, duplicates and cache state: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.operators import cache, dedup, ocr
from ledgerloom.sources import files
from ledgerloom.sources.records import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = dt.datetime(2024, 3, 1)


def add(name: str, plan, text: str | None, head: str = files.FILES_SQL) -> None:
    """``plan`` takes the file table."""
    QUERIES[name] = lambda spark, sf_dir: plan(files.from_documents(spark, sf_dir))
    if text:
        text = text.strip()
        SQL[name] = f"WITH {head}, {text[5:]}" if text.startswith("WITH ") else f"WITH {head} {text}"


_image = lambda: F.col("mime").startswith("image/")
add("scan_recent", lambda c: c.where(_image() & (F.col("cached_at") >= F.lit(AS_OF) - F.expr("INTERVAL 30 DAY"))).select("file_id", "mime"), f"SELECT file_id, mime FROM c WHERE mime LIKE 'image/%' AND cached_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
add("search_contains", lambda c: c.where(F.contains("name", F.lit("_9"))).orderBy("file_id").limit(50).select("file_id", "name"), "SELECT file_id, name FROM c WHERE contains(name, '_9') ORDER BY 1 LIMIT 50")
add("search_icontains", lambda c: c.where(F.contains(F.lower("name"), F.lower(F.lit("iMg_8")))).select("file_id", "name"), "SELECT file_id, name FROM c WHERE contains(lower(name), 'img_8')")
add(
    "size_info", lambda c: c.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(_image()).alias("n_images"), F.sum("size").alias("bytes"), F.round(F.sum("size") / cache.MB, 2).alias("mb")),
    "SELECT count(*) AS n_files, count_if(mime LIKE 'image/%')::BIGINT AS n_images, sum(size)::BIGINT AS bytes, round(sum(size)::DOUBLE / 1048576, 2) AS mb FROM c",
)
add("cache_list", lambda c: cache.listing(c).withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss")), "SELECT file_id, coalesce(name, 'Unknown') AS name, coalesce(size, 0) AS size, strftime(coalesce(last_accessed, cached_at), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM c")
add(
    "cache_stats", lambda c: cache.statistics(cache.listing(c).join(c.select("file_id", "is_duplicate"), "file_id"), 10),
    """SELECT count(*) FILTER (NOT is_duplicate) AS unique_files, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (NOT is_duplicate) - count(*) FILTER (is_duplicate) AS unique_files_reported,
      round(coalesce(sum(size) FILTER (NOT is_duplicate), 0)::DOUBLE / 1048576, 2) AS size_mb, round(coalesce(sum(size) FILTER (NOT is_duplicate), 0)::DOUBLE / 1048576 / 10 * 100, 1) AS usage_percent FROM c""",
)
add("age_evict", lambda c: cache.aged(c, AS_OF, 30).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed_bytes")), f"SELECT count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS freed_bytes FROM c WHERE cached_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
_listed = lambda c: cache.listing(c).join(c.select("file_id", "is_duplicate"), "file_id")
add(
    "lru_evict", lambda c: cache.lru_evicted(_listed(c), 1_000_000).select("file_id", "removed_before"),
    """WITH x AS (SELECT file_id, coalesce(size, 0) AS size, coalesce(last_accessed, cached_at) AS t FROM c WHERE NOT is_duplicate),
    y AS (SELECT file_id, coalesce(sum(size) OVER (ORDER BY t, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS removed_before, sum(size) OVER () AS total FROM x)
    SELECT file_id, removed_before FROM y WHERE total - removed_before > 1000000""",
)
add("content_hash", lambda c: c.select("file_id", "digest"), "SELECT file_id, digest FROM c")
add("exact_dups", lambda c: dedup.first_of_content(c.select("file_id", "digest"), "file_id", "digest").where("file_id <> original_id").select("file_id", "original_id"), "WITH x AS (SELECT file_id, min(file_id) OVER (PARTITION BY digest) AS original_id FROM c) SELECT * FROM x WHERE file_id <> original_id")


def _resolve(c: DataFrame) -> DataFrame:
    marked = dedup.first_of_content(c.select("file_id", "digest"), "file_id", "digest")
    return marked.alias("a").join(c.alias("b"), F.col("a.original_id") == F.col("b.file_id"), "left").select("a.file_id", F.col("b.name").alias("stored_name"))


add("resolve_dups", _resolve, "WITH x AS (SELECT file_id, min(file_id) OVER (PARTITION BY digest) AS o FROM c) SELECT x.file_id, c.name AS stored_name FROM x LEFT JOIN c ON x.o = c.file_id")
add("incremental_anti", lambda c: dedup.cached_anti(c.select("file_id", "mime"), c.where("file_id % 3 = 0").select("file_id"), "file_id"), "SELECT file_id, mime FROM c WHERE file_id % 3 <> 0")
add("ingest", lambda c: cache.ingest(c.select("file_id", "digest", F.coalesce("size", F.lit(0)).alias("size")), c.where("file_id % 4 = 0").select("file_id")), """WITH n AS (SELECT *, min(file_id) OVER (PARTITION BY digest) AS first FROM c WHERE file_id % 4 <> 0)
  SELECT file_id, 'skipped' AS status, 'already cached' AS reason FROM c WHERE file_id % 4 = 0
  UNION ALL SELECT file_id, CASE WHEN coalesce(size, 0) = 0 THEN 'error' ELSE 'processed' END, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN first <> file_id THEN 'duplicate content' END FROM n""")  # fmt: skip
QUERIES["cache_latest"] = lambda spark, sf_dir: cache.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")
SQL["cache_latest"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


# Recognition: candidates and words from orders and line items.
def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    share = lambda n: k * n % 101 / F.lit(100.0)
    return o.select("k", (k % 6 != 0).alias("vision_ok"), share(3).alias("vision_conf"), (k % 7 != 0).alias("doc_ok"), share(5).alias("doc_conf"), (k % 5 != 0).alias("tess_ok"), share(7).alias("tess_conf"))


QUERIES["ocr_fallback"] = lambda spark, sf_dir: ocr.choose(_candidates(spark, sf_dir)).select("k", "method", "confidence")
SQL["ocr_fallback"] = """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 6 <> 0 AS a, o_orderkey * 3 % 101 AS p, o_orderkey % 7 <> 0 AS b, o_orderkey * 5 % 101 AS q, o_orderkey % 5 <> 0 AS t, o_orderkey * 7 % 101 AS s FROM orders)
  SELECT k, CASE WHEN a AND p >= 80 THEN 'google_vision' WHEN b AND q >= 80 THEN 'document_detection' WHEN t THEN 'tesseract' ELSE 'none' END AS method,
    (CASE WHEN a AND p >= 80 THEN p WHEN b AND q >= 80 THEN q WHEN t THEN s ELSE 0 END) / 100.0::DOUBLE AS confidence FROM x"""
_words = lambda spark, sf_dir: read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 3).alias("paragraph"), ((F.col("l_partkey") + F.col("l_linenumber")) % 101).alias("percent"))
_WORDS = "w AS (SELECT l_orderkey AS k, l_suppkey % 3 AS paragraph, (l_partkey + l_linenumber) % 101 AS percent FROM lineitem)"
QUERIES["ocr_word_conf"] = lambda spark, sf_dir: ocr.word_confidence(_words(spark, sf_dir), "k")
SQL["ocr_word_conf"] = f"WITH {_WORDS} SELECT k, sum(percent)::DOUBLE / count(*)::DOUBLE / 100 AS confidence FROM w GROUP BY 1"
QUERIES["ocr_doc_conf"] = lambda spark, sf_dir: ocr.document_confidence(_words(spark, sf_dir), "k", "paragraph")
SQL["ocr_doc_conf"] = f"WITH {_WORDS}, p AS (SELECT k, paragraph, sum(percent)::DOUBLE / count(*)::DOUBLE AS p FROM w GROUP BY ALL) SELECT k, round(avg(p) / 100, 6) AS confidence FROM p GROUP BY 1"

# Vectors of 64 numbers stand for pictures of 8 by 8.
_vectors = lambda spark, sf_dir: read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
_B = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings)"
_SIGNED = "(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT"
_HASH = f"{_B}, b AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, (s[32] + s[33]) / 2 AS m FROM e), g AS (SELECT vec_id, sum(CASE WHEN x > m THEN (2::HUGEINT ** (64 - i))::HUGEINT ELSE 0 END)::HUGEINT AS h FROM b GROUP BY 1), hh AS (SELECT vec_id, {_SIGNED} AS h FROM g)"
_HASH = _HASH.replace("(2::HUGEINT ** (64 - i))::HUGEINT", "(1::HUGEINT << (64 - i)::INT)")
QUERIES["vec_hash"] = lambda spark, sf_dir: _vectors(spark, sf_dir).select("vec_id", H.median_hash(F.col("embedding")).alias("hash"))
SQL["vec_hash"] = f"WITH {_HASH} SELECT vec_id, h AS hash FROM hh"
QUERIES["vec_dhash"] = lambda spark, sf_dir: _vectors(spark, sf_dir).select("vec_id", H.gradient_hash(F.col("embedding")).alias("hash"))
SQL["vec_dhash"] = f"""WITH {_B}, b AS (SELECT vec_id, v, unnest(range(64)) AS i FROM e), d AS (SELECT vec_id, v[i + 2] > v[i + 1] AS bit, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS p FROM b WHERE i % 8 <> 7)
  SELECT vec_id, sum(CASE WHEN bit THEN 1::HUGEINT << (56 - p)::INT ELSE 0 END)::BIGINT AS hash FROM d GROUP BY 1"""
QUERIES["vec_quality"] = lambda spark, sf_dir: _vectors(spark, sf_dir).select("vec_id", *(F.round(c, 5).alias(n) for n, c in H.grid_quality(F.col("embedding")).items()), F.lit(64).alias("total_pixels"))
SQL["vec_quality"] = f"""WITH {_B}, b AS (SELECT vec_id, v, unnest(range(64)) AS i FROM e),
  l AS (SELECT vec_id, v[i + 1] AS x, v[(CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END) + 1] + v[(CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END) + 1] + v[(CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END) + 1] + v[(CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END) + 1] - 4 * v[i + 1] AS d FROM b)
  SELECT vec_id, round(var_pop(d), 5) AS sharpness, round(avg(x), 5) AS brightness, round(stddev_pop(x), 5) AS contrast, 64 AS total_pixels FROM l GROUP BY 1"""


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of vectors, and of some of them again with one or two bits changed."""
    h = _vectors(spark, sf_dir).select("vec_id", H.median_hash(F.col("embedding")).alias("h"))
    bit = lambda n: F.expr(f"shiftleft(1L, cast(vec_id * {n} % 60 as int))")
    some = h.where("vec_id % 5 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.col("h").bitwiseXOR(bit(1)).alias("h"))
    more = h.where("vec_id % 15 = 0").select((F.col("vec_id") + 2000000).alias("vec_id"), F.col("h").bitwiseXOR(bit(1)).bitwiseXOR(bit(7)).alias("h"))
    return h.union(some).union(more)


_VARIED = f"""{_HASH}, z AS (SELECT vec_id, h FROM hh UNION ALL SELECT vec_id + 1000000, xor(h, (1::BIGINT << (vec_id % 60)::INT)) FROM hh WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id + 2000000, xor(xor(h, (1::BIGINT << (vec_id % 60)::INT)), (1::BIGINT << (vec_id * 7 % 60)::INT)) FROM hh WHERE vec_id % 15 = 0),
  pr AS (SELECT a.vec_id AS id_1, b.vec_id AS id_2, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS similarity FROM z a JOIN z b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 3)"""
_pairs = lambda spark, sf_dir: dedup.hash_pairs(_hashes(spark, sf_dir), "vec_id", "h")
QUERIES["dup_pairs"] = _pairs
SQL["dup_pairs"] = f"WITH {_VARIED} SELECT * FROM pr"
QUERIES["best_match"] = lambda spark, sf_dir: dedup.best_matches(_hashes(spark, sf_dir), "vec_id", "h").withColumnRenamed("id", "id_2")
SQL["best_match"] = f"WITH {_VARIED} SELECT id_2, id_1 AS match_id, similarity FROM pr QUALIFY row_number() OVER (PARTITION BY id_2 ORDER BY similarity DESC, id_1) = 1"
QUERIES["hamming"] = lambda spark, sf_dir: (lambda h: h.alias("a").join(h.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", H.similarity(F.col("a.h"), F.col("b.h")).alias("similarity")))(_hashes(spark, sf_dir))
SQL["hamming"] = f"WITH {_VARIED} SELECT a.vec_id, 1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE AS similarity FROM z a JOIN z b ON b.vec_id = a.vec_id + 1"
QUERIES["dup_groups"] = lambda spark, sf_dir: dedup.hash_groups(_hashes(spark, sf_dir), "vec_id", "h")
SQL["dup_groups"] = f"WITH RECURSIVE {_VARIED}, ed AS (SELECT id_1 AS a, id_2 AS b FROM pr UNION SELECT id_2, id_1 FROM pr), re AS (SELECT a AS id, a AS g FROM ed UNION SELECT ed.b, re.g FROM re JOIN ed ON re.id = ed.a) SELECT id, min(g) AS group_id FROM re GROUP BY 1"


def _grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 by 8 of the varied hashes: their vector's, brighter by 1 or 2 where it is varied and its number is odd."""
    made = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(250), F.floor(x.cast("double") * 256) + 128)) + F.col("more"))
    vectors = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "of")
    ids = _hashes(spark, sf_dir).select("vec_id", (F.col("vec_id") % 1000000).alias("of"), F.when(F.col("vec_id") % 2 == 1, F.floor(F.col("vec_id") / 1000000)).otherwise(0).alias("more"))
    data = F.unhex(F.array_join(F.transform(made, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return ids.join(vectors, "of").select("vec_id", data.alias("data"), F.lit(8).alias("w"), F.lit(8).alias("h"))


QUERIES["dup_structural"] = lambda spark, sf_dir: dedup.verified(_pairs(spark, sf_dir), _grey(spark, sf_dir), "vec_id", "data", "w", "h")
SQL["dup_structural"] = f"""WITH {_VARIED}, o AS (SELECT z.vec_id, list_transform(embedding, lambda x: greatest(0, least(250, floor(x::DOUBLE * 256) + 128))::BIGINT + CASE WHEN z.vec_id % 2 = 1 THEN z.vec_id // 1000000 ELSE 0 END) AS p
    FROM z JOIN embeddings e ON e.vec_id = z.vec_id % 1000000),
  m AS (SELECT id_1, id_2, similarity, list_sum(list_transform(list_zip(a.p, b.p), lambda q: ((q[1] - q[2]) * (q[1] - q[2])) % 256))::DOUBLE / 64 AS mse FROM pr JOIN o a ON a.vec_id = id_1 JOIN o b ON b.vec_id = id_2),
  s AS (SELECT *, CASE WHEN mse = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 20 * log10(255 / sqrt(mse)) / 50)) END AS structural FROM m)
  SELECT id_1, id_2, similarity, structural, greatest(similarity, structural) AS score FROM s"""
