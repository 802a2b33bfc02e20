"""From raw documents to token ids: quality, near duplicates, secrets, mix, encoding.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the docs of the next one. All but the last return the
columns of docs, extra ones included. A result reads narrow tables that its stage wrote to the shared
folder, and no stage removes another's: results stay good for as long as the session. ``run`` knows when a result is written and drops
what it was made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard, mixing, quality, secrets
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.shared import drop, owning, stored, table

#: Near duplicates: words of a shingle and the least similarity.
SHINGLE, NEAR = 5, (80, 100)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(id, row) of every document, the row with all its columns, and the kind of the id: doc_id where it is a key, else one of our own."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).head()
    if n.n == n.ids:
        return docs.select(F.col("doc_id").alias("id"), row), "doc_id"
    return stored(docs.select(F.monotonically_increasing_id().alias("id"), row), "pipeline-rows"), "row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; null and empty texts are rejected."""
    return quality.keep(docs, "doc_id", "text", "lang", "source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; wordless ones stay.

    Where ids repeat or lack, rows are told apart by row, and a row goes only if its text is a near duplicate;
    of rows of one id, that with the smallest hash stays, and rows without an id come last.
    """
    rows, kind = _keyed(docs)
    texts = rows.select("id", F.col("row.text").alias("text"))
    found = jaccard.join(texts, "id", "text", SHINGLE, *NEAR)
    if kind == "doc_id":
        gone = stored(found.where("id <> component_id").select("id"), "pipeline-gone")
        return rows.join(gone, "id", "left_anti").select("row.*")
    rank = F.struct(F.col("row.doc_id").isNull().alias("lacks"), F.col("row.doc_id").alias("doc_id"), F.xxhash64("row").alias("hash"), "id")
    first = found.join(rows.select("id", rank.alias("rank")), "id").groupBy("component_id").agg(F.min("rank").alias("rank"))
    kept = stored(first.select(F.col("rank.id").alias("id")), "pipeline-kept")
    return rows.join(kept, "id", "left_semi").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    found = secrets.scan(row, "text").withColumn("clean", secrets.redact(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    new = {"text": F.col("clean"), "n_chars": F.when(hit, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each copy that the mix takes; those not taken go.

    The last copy of a source's stream counts whole. Repeated ids are told apart by row.
    """
    rows, _ = _keyed(docs)
    mixed = mixing.mix(rows.select("id", "row.text", "row.source"), "id", "text", "source")
    taken = stored(mixed.where("taken > 0").select("id", F.explode("positions").alias("at")), "pipeline-taken")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # positions spread evenly over [0, 1), so ranges need no sampling
    dealt = rows.join(taken, "id").repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col("at") * parts)).cast("int"))
    return dealt.sortWithinPartitions("at", "id").select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("byte-level bpe", byte_bpe),
]

#: SQL can't express the estimates, the merges and the hashed stream; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all others. When a stage's result is written, the tables of this run that it was made of go, the stage's own and its docs."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with owning() as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop(*before, *(df for df in made if df is not docs))
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
