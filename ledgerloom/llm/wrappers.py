"""Main text of pages by wrapper induction: trees of same-host pages are aligned, what is constant is template.

A page becomes blocks of text and a skeleton, its tree of block elements with runs of alike siblings as one node. The
commonest skeleton of a host is its reference; every other one is aligned to it by simple tree matching, so nodes of
all pages of the host have common names. A block that is the same at the same node in nearly all distinct pages of
the host is template, what varies is content. Menus, adverts and footers that vary from page to page can't be told
from articles that way; those go by elements and class names (see ``markup``).

Every page is read once, where it lies. Texts aren't shuffled unless the table of template blocks is large: hosts
exchange digests of blocks, each distinct skeleton is aligned once, and evidence is summed before it is dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import aligned, blocks, tree
from .shared import ship, stored

#: A block is template from so many distinct pages of a host on, in this share of those that have its node.
LEAST_PAGES, SHARE = 5, 0.9
#: Where a page declares its article and more than this share of it would be template, the host's pages are copies of each other, and all stays.
COPIES = 0.5
#: Template blocks that are sent to every task; more are joined.
BROADCAST = 200_000
_STEP = 256


def host_of(url: Column) -> Column:
    """The host of an address in lower case, empty without one."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _parsed(pages: DataFrame) -> DataFrame:
    kinds = {"skeleton": pa.string(), "declared": pa.bool_(), "texts": pa.list_(pa.string()), "places": pa.list_(pa.int32()), "prose": pa.list_(pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                found = [blocks(x or "") for x in batch.column("html").to_pylist()]
                made = [pa.array([getattr(p, name) for p in found], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("host"), *made], ["id", "url", "host", *kinds])

    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("id", "url", "host"))
    return stored(pages.mapInArrow(run, f"{kept}, skeleton string, declared boolean, texts array<string>, places array<int>, prose array<boolean>"), "pages")


def _names(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the nodes of a skeleton: places of the host's reference, or digests of their own paths where nothing matches."""
    for batch in rows:
        out = []
        for reference, skeleton in zip(batch.column("reference").to_pylist(), batch.column("skeleton").to_pylist()):
            labels, kids = tree(skeleton)
            if skeleton == reference:
                out.append(list(range(len(labels))))
                continue
            match, path = aligned(reference, skeleton), [""] * len(labels)
            for i, below in enumerate(kids):  # parents come before their children
                for n, k in enumerate(below):
                    path[k] = f"{path[i]}/{n}{labels[k]}"
            digest = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big")
            out.append([match[i] if i in match else -1 - digest(path[i]) for i in range(len(labels))])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("skel"), pa.array(out, pa.list_(pa.int64()))], ["host", "skel", "names"])


def _templates(parsed: DataFrame) -> DataFrame:
    """(host, skel, units) with the template blocks of pages of a skeleton, as (place, digest)."""
    units = F.array_distinct(F.arrays_zip(F.col("places").alias("place"), F.transform("texts", lambda t: F.xxhash64(t)).alias("digest")))
    rows = parsed.where("host <> '' AND size(texts) > 0").select("host", "skeleton", F.xxhash64("skeleton").alias("skel"), units.alias("units"))
    skeletons = rows.groupBy("host", "skel").agg(F.count(F.lit(1)).alias("n"), F.min("skeleton").alias("skeleton"))
    skeletons = stored(skeletons, "pages-skeletons")
    references = skeletons.groupBy("host").agg(F.max(F.struct("n", "skel", "skeleton")).alias("r")).select("host", F.col("r.skeleton").alias("reference"))
    names = stored(skeletons.join(references, "host").select("host", "skel", "skeleton", "reference").mapInArrow(_names, "host string, skel long, names array<long>"), "pages-names")
    # copies of a page count once
    distinct = rows.groupBy("host", "skel", F.xxhash64("units").alias("copy")).agg(F.min("units").alias("units"))
    places = F.transform(F.array_distinct(F.transform("units", lambda u: u["place"])), lambda p: F.struct(p.alias("place"), F.lit(None).cast("long").alias("digest")))
    seen = distinct.select("host", "skel", F.explode(F.concat("units", places)).alias("u")).groupBy("host", "skel", "u.place", "u.digest").agg(F.count(F.lit(1)).alias("n"))
    named = seen.join(names, ["host", "skel"]).select("host", F.get("names", F.col("place")).alias("name"), "digest", "n")
    counts = stored(named.groupBy("host", "name", "digest").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES), "pages-counts")
    of = counts.where("digest IS NULL").select("host", "name", F.col("n").alias("of"))
    constant = counts.where("digest IS NOT NULL").join(of, ["host", "name"]).where(F.col("n") >= SHARE * F.col("of"))
    own = names.select("host", "skel", F.posexplode("names").alias("place", "name"))
    unit = F.struct(F.col("place").cast("int").alias("place"), "digest")
    return stored(own.join(constant, ["host", "name"]).groupBy("host", "skel").agg(F.collect_set(unit).alias("template")), "pages-template")


def main_text(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Returns (``id_col``, ``url_col``, text, n_chars, n_template) of every row.

    ``text`` has the blocks of the main text in page order, one to a line, white space in a block as one space; empty if
    there is none, as for null or empty pages and pages of menus alone. ``n_template`` is the number of blocks that the wrapper of the
    host removed. Without an address or a host, or with fewer than ``LEAST_PAGES`` distinct pages of the host, a page is judged by its
    own elements. Equal pages count once. Rows of equal ids are pages each. Other columns are ignored; an empty table gives no rows.
    """
    ship(df.sparkSession)
    parsed = _parsed(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")))
    found = _templates(parsed)
    few = found.agg(F.coalesce(F.sum(F.size("template")), F.lit(0)).alias("n")).head().n <= BROADCAST
    known = F.broadcast(found) if few else found
    zipped = F.arrays_zip(F.col("texts").alias("text"), F.col("places").alias("place"), F.transform("texts", lambda t: F.xxhash64(t)).alias("digest"))
    rows = parsed.withColumn("skel", F.xxhash64("skeleton")).join(known, ["host", "skel"], "left")
    kept = F.filter(zipped, lambda u: ~F.array_contains("template", F.struct(u["place"].alias("place"), u["digest"].alias("digest"))))
    rows = rows.withColumn("kept", F.when(F.col("template").isNull(), F.col("texts")).otherwise(F.transform(kept, lambda u: u["text"])))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, t: a + F.length(t))
    copies = F.col("declared") & (chars("kept") < (1 - COPIES) * chars("texts"))
    rows = rows.withColumn("kept", F.when(copies, F.col("texts")).otherwise(F.col("kept"))).withColumn("text", F.array_join("kept", "\n"))
    return rows.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), (F.size("texts") - F.size("kept")).cast("long").alias("n_template")
    )
