"""The registered queries ``opN_<name>``: thin readings of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, jaccard, mixing, pivots, quality, secrets, sharding, tokenfiles, trie, warc, wrappers
from .shared import new_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.9)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(own, rows.schema))
    done = chat.format_conversations(rows, "conv_id", "turn", "role", "text")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text", 8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary, pattern, path = tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, new_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    tokenfiles.write(docs, "doc_id", "text", path, lambda: tokenfiles.library_encoder(vocabulary, pattern, added=True), end_id=2)
    back = tokenfiles.read(spark, path, "doc_id")
    return back.select("doc_id", "start", "n_tokens", tokenfiles.checksum(F.col("ids")).alias("ids_crc32"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)),
        F.sha2(secrets.named(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.named(F.col("spans")).alias("spans"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    header = F.col("header")
    return warc.read(spark, path).select(
        warc.page_of(header).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        warc.field(header, "WARC-Type").alias("record_type"),
        warc.page_of(header, "WARC-Refers-To").alias("refers_to"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=90, den=100)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    ordered = mixing.by_position(mixed, "doc_id")
    first = F.floor(F.get("positions", F.lit(0)) * 1e6).cast("long")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("copies"), first.alias("position_ppm"))


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html").drop("n_template")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", spliced=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_chat": op2_chat,
    "op3_sharding": op3_sharding,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_files": op5_token_files,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_pages": op11_pages,
    "op12_codes": op12_codes,
    "op13_trie": op13_trie,
}


def _op2_sql() -> str:
    text = f"replace(text, '{chat.ESCAPE}', '{chat.ESCAPE}{chat.SELF}')"
    for control, code in chat.CODES.items():
        text = f"replace({text}, '{control}', '{chat.ESCAPE}{code}')"
    marks = len(chat.START) + len(chat.END) + 2
    return f"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(role) + length({text}) + {marks})::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id
    """


_OP10_SQL = """
    WITH d AS (SELECT doc_id, source, md5('0:' || doc_id) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w, 3 * source_size AS most, [1.0, 1.5, 0.5][i % 3 + 1]::DOUBLE AS a, [1.0, 0.5, 1.5][i % 3 + 1]::DOUBLE AS b FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    v AS (SELECT level FROM l WHERE level * w <= most ORDER BY most / w, i LIMIT 1),
    t AS (SELECT l.source, source_size, a, b, least(most::DOUBLE, v.level * w) AS target FROM l, v),
    p AS (SELECT doc_id, size, source_size, a, b, target,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    n AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - c)) AS x, greatest(0, least(size, floor(target)::BIGINT - c - source_size)) AS y,
      greatest(0, least(size, floor(target)::BIGINT - c - 2 * source_size)) AS z FROM p)
    SELECT doc_id, size, source_size, target, (x + y + z)::BIGINT AS taken, ((x > 0)::INT + (y > 0)::INT + (z > 0)::INT)::BIGINT AS copies,
      CASE WHEN x > 0 THEN floor(CASE WHEN a = b THEN c / target ELSE (sqrt(a * a + (b - a) * (a + b) * (c / target)) - a) / (b - a) END * 1e6)::BIGINT END AS position_ppm
    FROM n
"""

def _op12_sql() -> str:
    """Six rounds spelled out; a distance and its entry are compared as one number."""
    parts, n = codes.PARTS, codes.ENTRIES
    rounds = []
    for k in range(codes.ROUNDS + 1):
        rounds.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p.p, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {n} + e) AS m
          FROM p JOIN b{k} b ON p.p = b.p GROUP BY vec_id, p.p)""")
        if k < codes.ROUNDS:
            rounds.append(f"""s{k} AS (SELECT p, e, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
            SELECT p.p, m % {n} AS e, i, sum(p.x[i]) AS s, count(*) AS n FROM p JOIN a{k} a ON p.vec_id = a.vec_id AND p.p = a.p, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY p.p, m % {n}, i) GROUP BY p, e),
          b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM b{k} b LEFT JOIN s{k} s ON b.p = s.p AND b.e = s.e)""")
    return f"""
        WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS place, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS x
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, place, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(p)),
        b0 AS (SELECT p, place - 1 AS e, x FROM p WHERE place <= {n}),
        {", ".join(rounds)},
        f AS (SELECT vec_id, string_agg(printf('%02x', (m % {n})::INT), '' ORDER BY p) AS code, sum(m // {n})::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
          (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{codes.ROUNDS}) AS codebooks_sha256
        FROM f JOIN v USING (vec_id)
    """


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda j: ascii(substr(conv_id::VARCHAR, j::INT, 1))::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_OP13_SQL = f"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT conv_id, max(i) AS n FROM t GROUP BY conv_id),
    c AS (SELECT l.conv_id, base, h, least(h, coalesce(b.n, 0)) AS taken FROM (SELECT conv_id, conv_id - conv_id % {trie.FAMILY} AS base, {_CRC} % {trie.SPLICE} AS h FROM l) l LEFT JOIN l b ON b.conv_id = base),
    r AS (SELECT c.conv_id, i AS depth, said, bytes FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT conv_id, taken + i - h, said, bytes FROM c JOIN t USING (conv_id) WHERE i > h),
    p AS MATERIALIZED (SELECT conv_id, depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    q AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
    n AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM q GROUP BY key, depth),
    k AS (SELECT key[: length(key) - 64] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
    s AS (SELECT p.key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM n LEFT JOIN k USING (key) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n u ON u.key = n.key[: length(n.key) - 64] AND n.depth > 0
"""

#: For pages with one article of headings, paragraphs and inline elements, as the tables have them, where no wrapper finds a constant block in one.
_OP11_SQL = r"""
    WITH b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>'),
      lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS x FROM pages),
    t AS (SELECT page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), chr(10)) AS text FROM b)
    SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

ORACLE_SQL: dict[str, str] = {
    "op11_pages": _OP11_SQL,
    "op12_codes": _op12_sql(),
    "op13_trie": _OP13_SQL,
    "op2_chat": _op2_sql(),
    "op10_mixing": _OP10_SQL,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        q AS (SELECT page_id, strlen(t) AS n, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
          CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q
    """,
}
