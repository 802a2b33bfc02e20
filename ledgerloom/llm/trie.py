"""Trie of conversations: every distinct sequence of first turns is a node, totals come by leaf peeling.

Turns are brought into one global order of (conversation, turn, role, text), dealt in ranges of that order, so that a
conversation of any length spreads over tasks. Each range computes positions and polynomial hashes (two bases, modulus
2^61 - 1) of what a conversation has in it; what a conversation had in earlier ranges is one state for each range, the
only thing that the driver combines. The hash of first turns names a node.

Totals of subtrees are passed from leaves to the root: a node holds the number of children that haven't reported; one
that waits for none sends its totals to its parent and is done, until the root is. A run of nodes of one conversation
with one child each moves as one, so rounds grow with the branchings on a path, not with its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, ship, stored

#: Modulus and the two bases of the hashes.
PRIME, BASES = (1 << 61) - 1, (1_113_861_972_437_521_867, 2_005_447_083_659_912_339)
#: Splicing: conversations of a family start with the head of its first one, of up to SPLICE - 1 turns.
FAMILY, SPLICE = 5, 9
#: Ids in a range of so many numbers are one string before they are hashed.
CHUNK = 4096
_COMPACT = 16
_SCANNED = "part int, conv_id long, i long, b1 long, b2 long, a1 long, a2 long, bytes long"
_PREFIXES = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, bytes long"


def _digests(role: Column, text: Column) -> list[Column]:
    """Two numbers of 60 bits of a turn."""
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(whole, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "d1"), (16, "d2"))]


def _batch(columns: list, names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and hashes before and after each turn, of what its conversation has in this range."""
    part, conv = TaskContext.get().partitionId(), None
    i = one = two = 0
    for batch in batches:
        out = []
        for c, x, y in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "d1", "d2"))):
            if c != conv:
                conv, i, one, two = c, 0, 0, 0
            i, before = i + 1, (one, two)
            one, two = (one * BASES[0] + x) % PRIME, (two * BASES[1] + y) % PRIME
            out.append((c, i, *before, one, two))
        if out:
            yield _batch([np.full(len(out), part, np.int32), *zip(*out), batch.column("bytes")], _SCANNED)


def _carried(scan: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """For each range: conversation, turns and hashes of the conversation that the ranges before it end with."""
    last = F.max(F.struct("conv_id", "i", "a1", "a2")).alias("last")
    state, out = None, {}
    for r in scan.groupBy("part").agg(F.min("conv_id").alias("first"), last).orderBy("part").collect():  # a row for each partition
        if state and state[0] == r.first:
            out[r.part] = state
        goes_on = r.part in out and r.last.conv_id == r.first
        conv, n, one, two = r.last
        state = (conv, out[r.part][1] + n, *((out[r.part][2 + k] * pow(BASES[k], n, PRIME) + own) % PRIME for k, own in enumerate((one, two)))) if goes_on else (conv, n, one, two)
    return out


def ordered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row for each turn with a conversation: its place from 1, the hashes before and after it, the bytes of its text."""
    ship(df.sparkSession)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text")).where("conv_id IS NOT NULL")
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    narrow = rows.select("conv_id", *_digests(F.col("role"), F.col("text")), F.octet_length("text").cast("long").alias("bytes"))
    scan = stored(narrow.mapInArrow(_scan, _SCANNED), "trie-turns")
    carried = _carried(scan)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            hit = np.zeros(len(part), bool)
            for p in np.unique(part).tolist():
                hit |= (part == p) & (conv == carried[p][0]) if p in carried else False
            if hit.any():
                cols = [c.to_numpy().copy() for c in batch.columns]
                for r in np.flatnonzero(hit).tolist():
                    _, n, *state = carried[int(part[r])]
                    own = int(cols[2][r])
                    for k in (0, 1):
                        for at, turns in ((3 + k, own - 1), (5 + k, own)):
                            cols[at][r] = (state[k] * pow(BASES[k], turns, PRIME) + int(cols[at][r])) % PRIME
                    cols[2][r] = own + n
                batch = _batch([pa.array(c) for c in cols], _SCANNED)
            yield batch

    return scan.mapInArrow(carry, _SCANNED).drop("part") if carried else scan.drop("part")


def plain_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the conversations as they are, and (conv_id, n) of each."""
    found = turns.select("conv_id", F.col("i").alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("b1").alias("p1"), F.col("b2").alias("p2"), "bytes")
    return found, turns.groupBy("conv_id").agg(F.max("i").alias("n"))


def spliced_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the rebuilt conversations, and (conv_id, n) of each.

    Conversation c starts with the first h turns of c - c % FAMILY, h = crc32(c) % SPLICE, and goes on with what it has after
    its own first h. A hash of the new beginning takes the place of the old one's in the hashes of later turns.
    """
    head = F.when(F.col("i") < SPLICE, F.struct("i", "a1", "a2", "b1", "b2", "bytes"))  # at most SPLICE - 1 of each
    own = turns.groupBy("conv_id").agg(F.max("i").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % SPLICE
    of = own.select("conv_id", "n", (c - c % FAMILY).alias("base"), h.alias("h"), F.get("head", (h - 1).cast("int")).alias("old"))
    of = of.join(own.select(F.col("conv_id").alias("base"), F.col("head").alias("given")), "base", "left")
    taken = F.least("h", F.coalesce(F.size("given"), F.lit(0)).cast("long"))
    of = of.withColumn("taken", F.when(F.col("given").isNull(), 0).otherwise(taken)).withColumn("new", F.get("given", (F.col("taken") - 1).cast("int")))
    of = stored(of.select("conv_id", "n", "h", "taken", "old", "new", F.slice("given", F.lit(1), F.col("taken").cast("int")).alias("given")), "trie-convs")
    heads = of.select("conv_id", F.explode("given").alias("x"))
    heads = heads.select("conv_id", F.col("x.i").alias("depth"), F.col("x.a1").alias("k1"), F.col("x.a2").alias("k2"), F.col("x.b1").alias("p1"), F.col("x.b2").alias("p2"), F.col("x.bytes").alias("bytes"))
    at = lambda s, n: F.coalesce(F.col(f"{s}.{n}"), F.lit(0)).alias(f"{s}_{n}")
    keys = of.where("n > h").select("conv_id", "h", "taken", at("old", "a1"), at("old", "a2"), at("new", "a1"), at("new", "a2"))
    rows = turns.join(keys, "conv_id").where("i > h").select("conv_id", "i", "h", "taken", "a1", "a2", "b1", "b2", "bytes", "old_a1", "old_a2", "new_a1", "new_a2")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [[1], [1]]
        for batch in batches:
            out = []
            for _, i, h, t, a1, a2, b1, b2, _, o1, o2, n1, n2 in zip(*(c.to_pylist() for c in batch.columns)):
                past = i - h
                for k in (0, 1):
                    while len(powers[k]) <= past < 1 << 16:
                        powers[k].append(powers[k][-1] * BASES[k] % PRIME)
                power = lambda k, n: powers[k][n] if n < 1 << 16 else pow(BASES[k], n, PRIME)  # noqa: B023, E731
                put = lambda hash_, k, o, new, n: (hash_ + (new - o) * power(k, n)) % PRIME
                out.append((t + past, put(a1, 0, o1, n1, past), put(a2, 1, o2, n2, past), put(b1, 0, o1, n1, past - 1), put(b2, 1, o2, n2, past - 1)))
            if out:
                yield _batch([batch.column("conv_id"), *zip(*out), batch.column("bytes")], _PREFIXES)

    rebuilt = of.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return heads.unionByName(rows.mapInArrow(compose, _PREFIXES)), rebuilt


def _digest_of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the strings of each node, in their order, joined by commas."""
    rows = ((r[:3], r[3]) for batch in chunks for r in zip(*(batch.column(k).to_pylist() for k in ("depth", "k1", "k2", "ids"))))
    for (depth, k1, k2), held in groupby(rows, key=lambda r: r[0]):
        sha, mark = hashlib.sha256(), b""
        for _, ids in held:
            sha.update(mark + ids.encode())
            mark = b","
        yield _batch([[depth], [k1], [k2], [sha.hexdigest()]], "depth long, k1 long, k2 long, sha string")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha) of the ids of conversations that end in a node, in the order of numbers.

    Ids in one range of CHUNK numbers become one string, many tasks to a node; only those strings meet in its task, which holds one at a time.
    """
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ("depth", "k1", "k2")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*key, F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk")).agg(ids.alias("ids"))
    return chunks.repartition(parts, *key).sortWithinPartitions(*key, "chunk").select(*key, "ids").mapInArrow(_digest_of, "depth long, k1 long, k2 long, sha string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For nodes in the order of (conv_id, depth): the run that a node is in, what nodes above it in the run save, whether it is the last."""
    g, above, held = TaskContext.get().partitionId() << 40, 0, None
    names = "conv_id long, depth long, g long, above long, bottom int"
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "n_children", "own"))):
            if held:
                goes_on = held[2] == 1 and row[0] == held[0] and row[1] == held[1] + 1
                out.append((held[0], held[1], g, above, int(not goes_on)))
                g, above = (g, above + held[3]) if goes_on else (g + 1, 0)
            held = row
        if out:
            yield _batch([*zip(*out)], names)
            out = []
    if held:
        yield _batch([[held[0]], [held[1]], [g], [above], [1]], names)


def _peeled(runs: DataFrame) -> DataFrame:
    """(g, leaves, saved) of the subtrees of runs (g, up, waits, leaves, saved), ``up`` the run that it reports to."""
    done: list[DataFrame] = []
    while True:
        ready = runs.where("waits = 0")
        done.append(ready.select("g", "leaves", "saved"))
        sent = ready.where("up IS NOT NULL").groupBy(F.col("up").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        rest = runs.where("waits > 0").join(sent, "g", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        runs = stored(rest.select("g", "up", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), plus("leaves", "l"), plus("saved", "s")), "trie-runs")
        if runs.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if len(done) == _COMPACT:
            done = [stored(reduce(DataFrame.unionByName, done), "trie-done")]


def trie(prefixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie of ``prefixes``; ``sizes`` has every conversation, those without turns too."""
    spark, key = prefixes.sparkSession, ("depth", "k1", "k2")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prefixes, sizes = stored(prefixes, "trie-prefixes"), stored(sizes, "trie-sizes")
    made = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    none = F.lit(None).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(k) for k in key), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = stored(made.unionByName(root), "trie-nodes")
    up = F.col("depth") - 1
    children = nodes.where("depth > 0").groupBy(up.alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    last = prefixes.join(sizes, "conv_id").where("depth = n").select(*key, "conv_id")
    last = last.unionByName(sizes.where("n = 0").select(*(F.lit(0).cast("long").alias(k) for k in key), "conv_id"))
    full = nodes.join(children, [*key], "left").join(_ends(last), [*key], "left")
    top = nodes.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # children of the root, which may be most nodes, need no join on its key
    first = full.where("depth = 1").join(F.broadcast(top), "depth")
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rest = full.where("depth > 1").join(parents, ["depth", "p1", "p2"])
    full = first.unionByName(rest).unionByName(full.where("depth = 0").withColumn("parent_conv_id", none))
    own = (F.col("n_convs") - 1) * F.col("bytes")
    full = stored(full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), own.alias("own"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie-full")
    drop(nodes, prefixes, sizes)
    dealt = full.select("conv_id", "depth", "n_children", "own").repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    placed = stored(dealt.mapInArrow(_runs, "conv_id long, depth long, g long, above long, bottom int"), "trie-placed")
    full = stored(full.join(placed, ["conv_id", "depth"]), "trie-placed-nodes")
    upper = F.min(F.struct("depth", "parent_conv_id")).alias("top")
    waits = F.sum(F.col("n_children") * F.col("bottom"))
    runs = full.groupBy("g").agg(upper, waits.alias("waits"), F.sum("own").alias("saved"))
    bottoms = placed.where("bottom = 1").select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("g").alias("up"))
    runs = runs.select("g", "waits", "saved", F.when(F.col("waits") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("top.parent_conv_id").alias("up_conv"), (F.col("top.depth") - 1).alias("up_depth"))
    runs = stored(runs.join(bottoms, ["up_conv", "up_depth"], "left").select("g", "up", "waits", "leaves", "saved"), "trie-runs")
    return full.join(_peeled(runs), "g").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("above")).alias("saved_tokens"), "ends_sha256")


def conversation_trie(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, spliced: bool = False) -> DataFrame:
    """Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node is a distinct sequence of a conversation's first turns (role, text), in the order of turns, null first, then of
    role and text where turns repeat; repeated rows are turns of their own. ``conv_id`` is its smallest member. Null roles
    and texts are empty. Rows without a conversation belong to none. Ids are integers. With ``spliced`` the conversations
    are rebuilt first (see ``spliced_prefixes``). Other columns are ignored; an empty table has no member and no node.
    """
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col)
    return trie(*(spliced_prefixes if spliced else plain_prefixes)(turns))
