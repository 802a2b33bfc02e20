"""N-gram Jaccard join by signature trees.

Every document's set of word shingles has a signature: a bitmap with one bit for each token. Leaves of
a tree hold documents in order of size, inner nodes the OR of the bitmaps below and the range of their
sizes. Two nodes are compared by the most tokens that two documents below them can share: common bits,
plus the tokens that bitmaps hide in bits set twice. A pair of nodes whose sizes are too different, or
that can't share enough, is left with all that is below it; the rest is descended into, and pairs of
documents that remain are checked exactly on their texts, word by word.

Spread over a cluster, the forest has a root for each shingle among the first of some documents. In one order of
all shingles, two sets that are similar enough share one of their first n - ceil(n * num / den) + 1 shingles, n being
the size of each, so every pair has a common root, without exception. The order puts shingles that a sample of
the documents shows to be frequent behind all others; it decides how large roots are and never what is found.
Under the first shingle that two similar sets share, sizes and places show that enough can follow: under the root of a rare shingle
a document stays only with another for which they do. Then parities, bitmaps of an eighth of the size that count tokens modulo 2, show
how many tokens two sets at least don't share. What unrelated documents share by chance is left there before bitmaps are sent.
The steps are:

1. each document is compared with the smallest document of the most of its roots, if that is smallest in a share ``VOTES`` of
   the first shingles that count for equal sizes, which joins most copies in time proportional to their number; equal sets are one class;
2. under each root with documents of more than one component so far, trees are compared; pairs
   within a component are left out, and so are roots whose documents all stand under another root. A large root is cut by ranges
   of sizes, of which only neighbours can be similar, and these into blocks of bounded size, compared two by two;
3. the pairs that remain are checked in groups, a root's or a part of it, to which each document's text comes once; the
   likeliest go first, and a pair that others have joined already is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import steps
from .graph import components
from .shared import drop, ship, stored, tidy
from .shingles import Order, Parities, alike, bitmap, digest, exact_sets, folded, forget, parity, shingle_set

#: Documents of one block of a root, and of one leaf.
BLOCK, LEAF = 512, 16
#: Documents that show which shingles are frequent: a share of all within these bounds; in how many of them, and the most that are told apart.
SHARE, SAMPLE, LEAST_SEEN, MOST_FREQUENT = 0.01, (4096, 100_000), 3, 65_536
#: Share of a document's first shingles under which another must be the smallest to be compared with it at once.
VOTES = 0.3
#: Roots of a document before one of its roots that are tried for holding all of its documents.
TRIED = 4
#: Bits by which documents that no pair asks for are left out before the join that decides.
SPOTS = 1 << 24
#: Keys of rare shingles that one task brings together, about.
KEYS = 4_000_000
#: Documents of a root, next to one in order of size, that it is held against by size and place.
NEAR = 64


class Tree:
    """A signature tree over documents: sizes, bitmaps of one width, components so far."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, parts: np.ndarray):
        self.order = np.lexsort((parts, sizes))
        self.sizes, self.bits, self.parts = sizes[self.order], bits[self.order], parts[self.order]
        self.hidden = self.sizes - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        n = len(sizes)
        self.nodes: list[tuple] = []  # from, to, OR, most hidden, the one component or None, children
        self.root = self._build(0, n)

    def _build(self, a: int, b: int) -> int:
        below = ()
        if b - a > LEAF:
            mid = (a + b) // 2
            below = (self._build(a, mid), self._build(mid, b))
            union = self.nodes[below[0]][2] | self.nodes[below[1]][2]
        else:
            union = np.bitwise_or.reduce(self.bits[a:b], axis=0)
        own = self.parts[a:b]
        one = own[0] if (own == own[0]).all() else None
        self.nodes.append((a, b, union, int(self.hidden[a:b].max()), one, below))
        return len(self.nodes) - 1


def pairs(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of documents of the two trees that may be similar enough; x may be y."""
    stack = [(x.root, y.root)]
    while stack:
        i, j = stack.pop()
        a, b, or_x, hidden_x, part_x, below_x = x.nodes[i]
        c, d, or_y, hidden_y, part_y, below_y = y.nodes[j]
        low_x, high_x, low_y, high_y = int(x.sizes[a]), int(x.sizes[b - 1]), int(y.sizes[c]), int(y.sizes[d - 1])
        if high_x * den < num * low_y or high_y * den < num * low_x or part_x is not None and part_x == part_y:
            continue
        most = int(np.bitwise_count(or_x & or_y).sum()) + min(hidden_x, hidden_y)
        if min(most, high_x, high_y) * (num + den) < num * (low_x + low_y):
            continue
        if x is y and i == j and below_x:
            stack += [(below_x[0], below_x[0]), (below_x[0], below_x[1]), (below_x[1], below_x[1])]
        elif below_x and (not below_y or b - a >= d - c):
            stack += [(k, j) for k in below_x]
        elif below_y:
            stack += [(i, k) for k in below_y]
        else:
            n, m = x.sizes[a:b, None], y.sizes[None, c:d]
            common = np.bitwise_count(x.bits[a:b, None] & y.bits[None, c:d]).sum(axis=2, dtype=np.int64)
            most = np.minimum(common + np.minimum(x.hidden[a:b, None], y.hidden[None, c:d]), np.minimum(n, m))
            good = (most * (num + den) >= num * (n + m)) & (x.parts[a:b, None] != y.parts[None, c:d])
            if x is y and i == j:
                good = np.triu(good, 1)
            p, q = np.nonzero(good)
            yield p + a, q + c


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that several documents of a sample have, the rarest first."""
    n = docs.count()
    wanted = min(max(SHARE * n, SAMPLE[0]), SAMPLE[1])
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(n)) < F.lit(math.ceil(wanted))) if n > wanted else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in steps(batch, 1):
                    own = np.concatenate([shingle_set(t.as_py(), k) for t in part.column(1)])
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])
        finally:
            forget()
            tidy()

    seen = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEN)
    found = seen.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.array([r.h for r in reversed(found)], np.int64).view(np.uint64)


def _sketches(docs: DataFrame, k: int, order: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = order.value.first
        try:
            for batch in batches:
                for part in steps(batch, 1):
                    sets = [shingle_set(t.as_py(), k) for t in part.column(1)]
                    keys = [first(s) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                            pa.array([len(r) for r, _ in keys], pa.int32()),
                            pa.array([r.tobytes() for r, _ in keys], pa.binary()),
                            pa.array([f.view(np.int64) for _, f in keys], pa.list_(pa.int64())),
                            pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                            pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
                        ],
                        ["id", "n", "digest", "n_rare", "rare", "often", "bits", "parity"],
                    )
        finally:
            forget()
            tidy()

    return docs.mapInArrow(run, "id long, n long, digest binary, n_rare int, rare binary, often array<long>, bits binary, parity binary")


def _met(keys: np.ndarray, n: np.ndarray, num: int, den: int, like: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether rows, in order of key and size, have another of their key that may be similar enough by size and ``like``, of two arrays of rows.

    More than ``NEAR`` places apart, sizes alone decide.
    """
    good, low = np.zeros(len(keys), bool), np.arange(len(keys))
    for d in range(1, NEAR + 2):
        low = low[: np.searchsorted(low, len(keys) - d)]
        low = low[(keys[low] == keys[low + d]) & (n[low] * den >= num * n[low + d])]
        if not len(low):
            break
        both = low if d > NEAR else low[like(low, low + d)]
        good[both] = good[both + d] = True
    return good


def _rare_roots(sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, first): the documents under each root of a rare shingle that may be similar to another there, but the smallest of them, and that.

    Keys go to their task in packed runs, a run for each batch and task, and most are found to be of one document there. ``reach`` is the number of
    a set's shingles from the key on: sets of which the key is the first common shingle share no more than the lesser reach, and every pair that
    is similar enough stands under its first common shingle.
    """
    total = sketches.agg(F.sum("n_rare")).head()[0] or 0
    buckets = max(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            keys, counts = np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)
            ids, n = (np.repeat(batch.column(c).to_numpy(), counts) for c in (0, 1))
            reach = n - (np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts))
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            own = np.argsort(bucket, kind="stable")
            some, start = np.unique(bucket[own], return_index=True)
            runs = list(zip(start.tolist(), [*start[1:].tolist(), len(own)]))
            packed = (x[own] for x in (keys, ids, n.astype(np.int32), reach.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in runs], pa.binary()) for x in packed)], ["bucket", "keys", "ids", "n", "reach"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        kinds = (np.int64, np.int64, np.int32, np.int32)
        keys, ids, n, reach = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held) if held else [()] * 4, kinds))
        held.clear()
        own = np.argsort(keys, kind="stable")
        same = keys[own[1:]] == keys[own[:-1]]
        own = own[np.append(same, False) | np.append(False, same)] if len(own) else own  # keys of several documents
        own = own[np.lexsort((n[own], keys[own]))]
        size, rest = n[own].astype(np.int64), reach[own].astype(np.int64)
        own = own[_met(keys[own], size, num, den, lambda i, j: np.minimum(rest[i], rest[j]) * (num + den) >= num * (size[i] + size[j]))]
        keys, ids = keys[own], ids[own]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else own
        if len(start):
            size = np.diff(np.append(start, len(keys)))
            low = np.repeat(np.minimum.reduceat(ids, start), size)
            some = np.flatnonzero(np.repeat(size > 1, size) & (ids != low))
            for at in range(0, len(some), 1 << 16):
                part = some[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(ids[part]), pa.array(low[part])], ["key", "id", "first"])
        tidy()

    packed = sketches.where("n_rare > 0").select("id", "n", "rare").mapInArrow(deal, "bucket long, keys binary, ids binary, n binary, reach binary")
    dealt = packed.repartitionById(buckets, F.col("bucket").cast("int")).select("bucket", "keys", "ids", "n", "reach")
    return dealt.mapInArrow(merge, "key long, id long, first long")


def _frequent_roots(sketches: DataFrame) -> DataFrame:
    """(key, id, first) under the roots of frequent shingles: equal sets are merged first, and the roots are few enough to be broadcast."""
    own = sketches.select("digest", "id", F.explode("often").alias("key")).groupBy("key", "digest").agg(F.min("id").alias("id"))
    own = stored(own.select("key", "id").distinct(), "jaccard-frequent")
    several = own.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "first")
    return own.join(F.broadcast(several), "key").where("id <> first").select("key", "id", "first")


def _apart(left: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of (key, members, id, part) with another of their key, of other ``part``, whose set may be similar enough by parities."""
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edge, names = NEAR + 1, ["key", "members", "id", "part"]

    def met(rows: pa.Table) -> np.ndarray:
        keys, part, n = (rows.column(c).to_numpy() for c in ("key", "part", "n"))
        odd = Parities(rows.column("parity").to_pylist())
        # den * common >= num * union: tokens of one set only are no more than this share of all
        near = lambda i, j: odd.differ(i, j) * (num + den) <= (n[i] + n[j]) * (den - num)

        def like(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = part[i] != part[j]
            out[out] = near(i[out], j[out])
            return out

        return _met(keys, n, num, den, like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is given when those as far away as ``_met`` looks have come; as many before it are held for those that follow."""
        held, given = None, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            elif held is None:
                return
            good = met(held)
            end = len(good) if batch is None else max(given, len(good) - edge)
            good[:given] = good[end:] = False
            yield from held.select(names).filter(pa.array(good)).combine_chunks().to_batches()
            cut = max(0, end - edge)
            held, given = held.slice(cut), end - cut
        tidy()

    rows = left.join(texts.select("id", "n", "parity"), "id").repartition(parts, "key").sortWithinPartitions("key", "n")
    return rows.select(*names, "n", "parity").mapInArrow(run, "key long, members long, id long, part long").distinct()


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents of the pairs, and some others."""
    return _likely(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()).select("id", "text")


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the ids, and some others. What is broadcast are ``SPOTS`` bits at most, which keep most other rows from being shuffled."""
    spot = F.pmod(F.xxhash64("id"), F.lit(SPOTS))
    place = lambda x: F.shiftright(x, 6)
    marks = ids.select(spot.alias("spot")).groupBy(place(F.col("spot")).alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))).alias("marks"))
    likely = docs.withColumn("spot", spot).join(F.broadcast(marks), place(F.col("spot")) == F.col("place"))
    return likely.where(F.bit_get("marks", F.pmod("spot", F.lit(64)).cast("int")) == 1).select(*docs.columns)


def _verified(asked: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, i, j, a, b, like) -> the pairs (a, b) that are similar enough by their texts, but those joined by others of their (key, i, j)."""
    parts = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = ["key", "i", "j"]
    ids = asked.select(*group, F.col("a").alias("id")).union(asked.select(*group, "b")).distinct()
    held = ids.join(texts, "id").select(*group, F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("like"), "text")
    both = held.union(asked.select(*group, F.lit(1), "a", "b", "like", F.lit(None).cast("string")))
    dealt = both.repartition(parts, *group).sortWithinPartitions(*group, "kind", F.desc("like"), "a", "b")

    def check(rows: list[tuple[int, int]], ids: list[int], texts: list[str]) -> Iterator[tuple[int, int]]:
        of: dict[int, list] = {}
        for i, own in zip(ids, exact_sets(texts, k)):
            of.setdefault(i, []).append(own)
        up = {i: i for i in of}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in rows:
            x, y = top(a), top(b)
            if x != y and any(alike(s, t, num, den) for s in of[a] for t in of[b]):
                up[x] = y
                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))

        out: list[tuple[int, int]] = []
        for _, own in groupby(rows(), key=lambda r: r[:3]):
            ids, texts, asked = [], [], []
            for _, _, _, kind, a, b, _, text in own:
                if kind:
                    asked.append((a, b))
                else:
                    ids.append(a)
                    texts.append(text)
            out += check(asked, ids, texts)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
        tidy()

    return dealt.mapInArrow(run, "a long, b long")


def _outermost(left: DataFrame) -> DataFrame:
    """Leaves out roots whose documents all stand under another root, which stays or is inside one that does.

    A passage that documents share gives roots one inside the other, as each document has the first of its shingles
    up to some place of the order. So for the document with the fewest roots under a root, the ones before it are tried.
    """
    own = Window.partitionBy("id").orderBy("key")
    before = F.array(*(F.lag("key", i).over(own) for i in range(1, TRIED + 1)))
    ranked = left.select("key", "id", before.alias("before"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("roots"))
    tried = ranked.groupBy("key").agg(F.min_by("before", F.struct("roots", "id")).alias("before"), F.count(F.lit(1)).alias("size"))
    tried = tried.select("key", "size", F.explode(F.array_compact("before")).alias("outer"))
    inside = left.select("key", "id").join(tried, "key")
    found = inside.join(left.select(F.col("key").alias("outer"), "id"), ["outer", "id"]).groupBy("key", "outer").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return left.join(found.where("n = size").select("key").distinct(), "key", "left_anti")


def _dealt(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, members, id, which, n, part) -> (key, i, j, block, root, ...): roots in blocks that are compared two by two.

    A root of over ``BLOCK`` documents becomes one for each range of sizes, which holds the documents of that range, compared
    with each other and with those of the range below.
    """
    large = F.col("members") > BLOCK
    step = math.log(den / num) * (1 + 1e-9) if num < den else 0
    level = F.floor(F.log("n") / step).cast("long") if step else F.col("n")
    ranges = rows.withColumn("root", F.col("key")).withColumn("level", F.when(large, level).otherwise(0)).withColumn("upper", F.explode(F.when(large, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ranges = ranges.withColumn("key", F.when(large, F.xxhash64("key", F.col("level") + F.col("upper"))).otherwise(F.col("key")))
    sizes = ranges.groupBy("key").agg(F.count(F.when(F.col("upper") == 0, 1)).alias("own"), F.count(F.lit(1)).alias("all")).where("own > 0 AND `all` > 1")
    first, rest = (F.ceil(n / BLOCK).cast("int") for n in (F.col("own"), F.col("all") - F.col("own")))
    hashed = F.xxhash64("id")
    block = F.when(F.col("upper") == 0, F.pmod(hashed, first)).otherwise(first + F.pmod(hashed, F.greatest(rest, F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("upper") == 0, first + rest).otherwise(first) - 1)
    placed = ranges.join(sizes, "key").select("key", "root", "id", "which", "n", "part", block.alias("block"), F.explode(others).alias("other"))
    return placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "id", "which", "n", "part")


def _compared(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, i, j, block, id, n, part, bits, root, roots) -> (key, i, j, a, b, like): pairs that trees can't rule out, with the share of bits in common.

    Rows of one (key, i, j) are in one partition.

    A pair of several roots leaves its task only under the first of them in the order of keys, which both documents know by
    their ``roots``: so it is one row however many roots it shares, and meets as many others as can be there.
    """
    dealt = rows.sortWithinPartitions("key", "i", "j", "block", "id")

    def tree(held: list[tuple], width: int) -> tuple[Tree, np.ndarray]:
        bits = np.stack([folded(np.frombuffer(x[7], np.uint64), width) for x in held])
        return Tree(np.array([x[5] for x in held]), bits, np.array([x[6] for x in held])), np.array([x[4] for x in held])

    def first(x: tuple, y: tuple) -> bool:
        """Whether the root where the two meet is the first that they share."""
        return x[9] == y[9] == x[8] or x[8] == min(set(x[10]).intersection(y[10]))

    def by_width(held: list[tuple]) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for x in held:
            out.setdefault(8 * len(x[7]), []).append(x)
        return out

    def compare(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Bitmaps of one width make a tree: folded to that of a much smaller document, a large one's would be full."""
        sides = [by_width(list(g)) for _, g in groupby(held, key=lambda x: x[3])]
        same = held[0][1] == held[0][2]
        if not same and len(sides) == 1:
            return
        for wide, own in sides[0].items():
            for width, others in sides[-1].items():
                low, high = (own, others) if wide < width else (others, own)
                if same and width < wide or wide != width and max(x[5] for x in low) * den < num * min(x[5] for x in high):
                    continue
                x, ids_x = tree(own, min(wide, width))
                y, ids_y = (x, ids_x) if same and wide == width else tree(others, min(wide, width))
                for p, q in pairs(x, y, num, den):
                    here = np.array([first(own[u], others[v]) for u, v in zip(x.order[p].tolist(), y.order[q].tolist())], bool)
                    p, q = p[here], q[here]
                    a, b = ids_x[x.order[p]], ids_y[y.order[q]]
                    like = np.bitwise_count(x.bits[p] & y.bits[q]).sum(axis=1, dtype=np.int64) / (x.sizes[p] + y.sizes[q])
                    one = np.ones(len(a), np.int64)
                    columns = [held[0][0] * one, held[0][1] * one, held[0][2] * one, np.maximum(a, b), np.minimum(a, b), like]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "i", "j", "a", "b", "like"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[pa.RecordBatch] = []
        for _, held in groupby(rows, key=lambda r: r[:3]):
            for made in compare(list(held)):
                if made.num_rows:
                    out.append(made)
            if len(out) >= 256:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        tidy()

    columns = ["key", "i", "j", "block", "id", "n", "part", "bits", "root", F.get("roots", F.lit(0)).alias("least"), "roots"]
    found = dealt.select(*columns).mapInArrow(run, "key long, i long, j long, a long, b long, like double")
    return found.where("a <> b")


def _sent(dealt: DataFrame, left: DataFrame, signed: DataFrame) -> DataFrame:
    """The rows of _dealt with the (id, which, bits, roots) of their documents, all rows of one (key, i, j) in one partition.

    Bitmaps are what is heavy here, and a document of a group of near copies stands under several roots of that group. Such roots mostly have
    the same least root among those of their documents, and those with the same one go to the same task, to which a document's bitmap is
    sent once. Blocks of large roots are spread by themselves.
    """
    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = left.select("key", F.min("key").over(Window.partitionBy("id")).alias("least"))
    near = least.groupBy(F.col("key").alias("root")).agg(F.min("least").alias("near"))
    alone = (F.col("key") == F.col("root")) & (F.col("i") == 0) & (F.col("j") == 0)
    task = F.pmod(F.xxhash64(F.when(alone, F.col("near")).otherwise(F.col("key")), "i", "j"), F.lit(parts)).cast("int")
    rows = dealt.join(near, "root").select("id", "which", task.alias("task"), F.struct("key", "i", "j", "block", "root", "n", "part").alias("row"))
    once = rows.repartition(parts, "id", "which").groupBy("id", "which", "task").agg(F.collect_list("row").alias("rows"))  # its roots, and this task's share of the blocks of large ones
    there = once.join(signed, ["id", "which"]).repartitionById(parts, F.col("task"))
    return there.select("id", "which", "bits", "roots", F.explode("rows").alias("row")).select("id", "which", "bits", "roots", "row.*")


def join(df: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Returns (``id_col``, n_shingles, component_id) of every row.

    Two documents link when den * |A and B| >= num * |A or B| of their sets of ``k``-word shingles;
    ``component_id`` is the smallest id reachable. Null, empty and wordless texts have no shingles
    and link with nothing, equal ones neither. ``id_col`` is an integer; rows with equal ids are
    one vertex with the links of all their texts, a row without an id links with nothing and has no component. Other columns are ignored, an empty table gives no
    rows. Broadcast are at most ``MOST_FREQUENT`` hashes and their roots, and ``SPOTS`` bits; no root is compared as a whole: blocks hold about ``BLOCK`` documents.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(Order(_frequent(docs, k), num, den))
    sketches = stored(_sketches(docs, k, order), "jaccard-sketches")
    sound = sketches.where("n > 0 AND id IS NOT NULL")
    classes = sound.groupBy("digest").agg(F.min("id").alias("b"))
    copies = stored(sound.select("id", "digest").join(classes, "digest").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "jaccard-copies")

    rare = _rare_roots(sound, num, den)
    unique = _unique(docs)
    if unique:  # a copy is left to its class's smallest document, which has the same roots; an id that repeats can be of several classes
        rare = rare.alias("r").join(copies.alias("c"), F.col("r.id") == F.col("c.a"), "left").select("key", F.coalesce("b", "id").alias("id"), "first").where("id <> first")
    members = stored(rare.distinct().union(_frequent_roots(sound)), "jaccard-roots")
    votes = members.groupBy("id", "first").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(F.col("id").alias("a")).agg(F.min_by(F.struct(F.col("first").alias("b"), F.col("n").alias("votes")), F.struct(-F.col("n"), "first")).alias("best")).select("a", "best.*")
    firsts = sound.groupBy(F.col("id").alias("a")).agg(F.min(F.col("n") * (den - num) / (den + num)).alias("few"))  # as far as sets of one size stand under their roots together
    stars = stored(best.join(firsts, "a").where(F.col("votes") >= VOTES * F.col("few")).select("a", "b"), "jaccard-stars")
    # a group for each document that leads others, in parts of about a block
    leads = stars.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    led = stars.join(leads, "b").select(F.col("b").alias("key"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("i"), F.lit(0).cast("long").alias("j"), "a", "b", F.lit(0.0).alias("like"))
    links = stored(_verified(led, _texts(docs, stars), k, num, den), "jaccard-links")
    joined = components(links)

    part = lambda column, name: joined.select(F.col("v").alias(column), F.col("component").alias(name))
    placed = members.join(part("id", "own"), "id", "left").join(part("first", "top"), "first", "left")
    placed = placed.select("key", "id", "first", F.coalesce("own", "id").alias("part"), F.coalesce("top", "first").alias("top"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"x{seed}") for seed in (1, 2)]
    mixed = placed.groupBy("key").agg(F.max(F.col("part") != F.col("top")).alias("several"), F.count(F.lit(1)).alias("others"), F.first("first").alias("first"), F.first("top").alias("top"), *same)
    mixed = mixed.where("several").groupBy("first", "others", "x1", "x2").agg(F.min("key").alias("key"), F.first("top").alias("top"))
    mixed = stored(mixed.select("key", "first", "top", (F.col("others") + 1).alias("members")), "jaccard-mixed")
    left = placed.select("key", "id", "part").join(mixed.select("key", "members"), "key").select("key", "members", "id", "part")
    left = left.union(mixed.select("key", "members", F.col("first").alias("id"), F.col("top").alias("part")))
    texts = sound.select("id", F.xxhash64("digest").alias("which"), "n", "bits", "parity")
    texts = texts if unique else texts.dropDuplicates(["id", "which"])
    every = stored(_apart(left.distinct(), texts, num, den), "jaccard-every")
    drop(members, mixed)
    left = stored(_outermost(every), "jaccard-left")
    drop(every)
    # bitmaps join when it is known where documents go, so that they move there at once
    texts = _likely(texts, left.select("id").distinct())
    roots = left.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("roots"))  # no more than the first shingles of the document
    dealt = _dealt(left.join(texts.select("id", "which", "n"), "id"), num, den)
    sent = _sent(dealt, left, texts.select("id", "which", "bits").join(roots, "id"))
    candidates = stored(_compared(sent, num, den).join(stars, ["a", "b"], "left_anti"), "jaccard-candidates")
    drop(left)
    more = stored(_verified(candidates, _texts(docs, candidates), k, num, den), "jaccard-more")
    found = components(links.union(more).union(copies))
    done = sketches.select("id", "n").join(found.withColumnRenamed("v", "id"), "id", "left")
    done = stored(done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "jaccard-done")
    drop(sketches, copies, stars, links, candidates, more, joined, found)
    return done


def _unique(docs: DataFrame) -> bool:
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).head()
    return n.n == n.ids
