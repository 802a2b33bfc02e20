"""Near-duplicate operators and the pipeline against brute force."""

import random


import numpy as np
import pytest

from ledgerloom.llm import graph, jaccard, pivots, shingles


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def own_set(t, k):
    w = tuple((t or "").encode().lower().split())
    return {w} if 0 < len(w) < k else {w[i : i + k] for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    groups = Sets({i for i, _ in rows})
    sets = [(i, own_set(t, k)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                groups.join(i, j)
    return sorted((i, len(s), groups.find(i)) for i, s in sets)


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoins") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = text(60)
    rows = []
    for _ in range(25):
        base = text(rnd.choice((3, 12, 80, 300)))
        for _ in range(rnd.randrange(1, 6)):
            near = list(base)
            for _ in range(rnd.randrange(4)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            rows.append(" ".join(near))
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(20)]
    hot = text(120)
    for i in range(60):
        near = list(hot)
        near[i % 120] = words[i]
        rows.append(" ".join(near))
    rows += ["", None, " \n", "Word", "word", "WORD x", "a b", "A\tB"] + ["copy of it all " * 10] * 15
    return [(i * 2, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_join(spark, k, num, den):
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, n int")
    assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", k, num, den).collect())) == brute(rows, k, num, den)


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", 3, 90, 100).collect())) == brute(rows, 3, 90, 100)
    assert jaccard.join(df.limit(0), "doc_id", "text").count() == 0
    df = df.union(spark.createDataFrame([(None, "a b c d"), (None, "only here")], df.schema))
    got = [tuple(r) for r in jaccard.join(df, "doc_id", "text", 3, 90, 100).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(rows, 3, 90, 100) and sorted(r for r in got if r[0] is None) == [(None, 1, None), (None, 2, None)]


def test_trees_keep_every_pair():
    """No pair that is similar enough is pruned, in one tree and between two."""
    rows = [(i, own) for i, t in corpus(9) if len(own := shingles.shingle_set(t, 3))]
    width = 256
    bits = np.stack([shingles.folded(np.frombuffer(shingles.bitmap(s), np.uint64), width) for _, s in rows])
    sizes = np.array([len(s) for _, s in rows])
    tree = jaccard.Tree(sizes, bits, np.arange(len(rows)))
    got = {frozenset((int(tree.order[a]), int(tree.order[b]))) for p, q in jaccard.pairs(tree, tree, 90, 100) for a, b in zip(p, q)}
    near = {frozenset((i, j)) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))}
    assert near <= got and len(got) < len(rows) ** 2 / 8
    half = len(rows) // 2
    x, y = jaccard.Tree(sizes[:half], bits[:half], np.arange(half)), jaccard.Tree(sizes[half:], bits[half:], np.arange(half, len(rows)))
    got = {frozenset((int(x.order[a]), half + int(y.order[b]))) for p, q in jaccard.pairs(x, y, 90, 100) for a, b in zip(p, q)}
    assert {s for s in near if len({v < half for v in s}) == 2} <= got


def test_blocks_of_a_large_root(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("k", [3, 5])
def test_similar_texts_without_hashes(k):
    rows = [t for _, t in corpus(7)[::2]]
    many = [(t or "") + "".join(f" {i}" for i in range(7000)) for t in rows[:3]]  # so many words that sequences no longer fit a number
    for every in (rows + ["", None, "word", "word word"], rows + many):
        sets, want = shingles.exact_sets(every, k), [own_set(t, k) for t in every]
        assert [len(x) for x, _ in sets] == [len(x) for x in want]
        for num in (80, 90, 100):
            for i in range(0, len(every), 5):
                got = [shingles.alike(sets[i], x, num, 100) for x in sets]
                assert got == [bool(x) and 100 * len(x & want[i]) >= num * len(x | want[i]) for x in want]


@pytest.mark.parametrize("num", [50, 80, 90, 100])
def test_similar_sets_share_a_first_shingle(num):
    rnd = np.random.default_rng(num)
    every = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    order = shingles.Order(rnd.permutation(every)[:120], num, 100)
    for _ in range(300):
        a = np.sort(rnd.permutation(every)[: rnd.integers(1, 60)])
        b = np.unique(np.concatenate((a[rnd.random(len(a)) < 0.95], rnd.permutation(every)[: rnd.integers(0, 6)])))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
            assert set(np.concatenate(order.first(a)).tolist()) & set(np.concatenate(order.first(b)).tolist())


def test_one_shingle_in_every_document(spark, monkeypatch):
    """A large root of documents of many sizes is compared by ranges of sizes; nothing is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rnd = random.Random(11)
    rows = [(i, " ".join(["same", "three", "words"] + [f"w{rnd.randrange(40)}" for _ in range(rnd.choice((0, 1, 2, 30, 33, 200)))])) for i in range(120)]
    rows += [(1000 + i, t + " end") for i, t in rows[::3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", 3, 90, 100).collect())) == brute(rows, 3, 90, 100)


def test_parities_never_exceed_the_difference():
    """Parities of any two sets, of one width or several, differ in no more bits than the sets do in tokens."""
    sets = [own for _, t in corpus(12) if len(own := shingles.shingle_set(t, 3))]
    sets += [np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)) for n in (1, 127, 128, 129, 900, 9000, 20000)]
    odd, every = shingles.Parities([shingles.parity(x) for x in sets]), np.arange(len(sets))
    assert len(set(odd.width.tolist())) > 3
    for i, x in enumerate(sets):
        got, want = odd.differ(np.full(len(sets), i), every), [len(np.setxor1d(x, y)) for y in sets]
        assert (got <= want).all() and got[i] == 0


@pytest.mark.parametrize("near", [2, 64])
def test_similar_sets_meet_under_their_first_shingle(monkeypatch, near):
    """By size and place under a root no pair that is similar enough is left out, however many stand between them."""
    monkeypatch.setattr(jaccard, "NEAR", near)
    sets = [own for _, t in corpus(13) if len(own := shingles.shingle_set(t, 3))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = np.intersect1d(a, b)
            if 100 * len(common) < 90 * len(np.union1d(a, b)):
                continue
            own = sorted((len(x), len(x) - int(np.searchsorted(x, common[0])), k) for k, x in enumerate(sets) if common[0] in x)
            n, reach, of = map(np.array, zip(*own))
            like = lambda p, q: np.minimum(reach[p], reach[q]) * 190 >= 90 * (n[p] + n[q])
            kept = set(of[jaccard._met(np.zeros(len(n), int), n, 90, 100, like)].tolist())
            assert {i, j} <= kept


def test_shingles_shared_by_chance_send_no_bitmaps(spark, monkeypatch):
    """Of documents that share shingles but aren't similar, and of sizes too different, no bitmap goes to a comparison."""
    rnd, sent, compared = random.Random(3), [], jaccard._compared
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = []
    for _ in range(60):
        passage = text(40)
        rows += [" ".join(text(rnd.randrange(30, 60)) + passage + text(rnd.randrange(30, 60))) for _ in range(2)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(jaccard, "_compared", lambda rows, *x: (sent.append(rows.count()), compared(rows, *x))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", 3, 90, 100).collect())) == brute(rows, 3, 90, 100)
    assert sent == [0]


def test_roots_cut_by_batches(spark):
    """Neighbours under a root that come in different batches still meet."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = corpus(14)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, jaccard.join(df, "doc_id", "text", 3, 90, 100).collect())) == brute(rows, 3, 90, 100)
    finally:
        spark.conf.set(key, before)


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(900, i) for i in range(500, 560)]
    groups = Sets({v for e in links for v in e})
    for a, b in links:
        groups.join(a, b)
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: groups.find(v) for e in links for v in e if any(a != b and v in (a, b) for a, b in links)}


def vectors(seed=1, n=900):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 64))
    near = [base[i % 40] + rng.normal(size=64) * rng.choice((0.1, 0.3, 0.45)) for i in range(300)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near])]
    return rows + [(5000 + i, rows[0][1]) for i in range(5)] + [(6000, [2 * x for x in rows[1][1]])]


def test_pivots_recall(spark):
    rows = vectors()
    odd = [(7000, None), (7001, [0.0] * 64), (7002, [float("nan")] * 64), (7003, [None] * 64), (7004, []), (7005, [1.0, 2.0]), (7006, [2.0, 4.0]), (None, rows[3][1][::-1]), (7007, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<float>, data string")
    got = {r.vec_id: r for r in pivots.near_duplicates(df, "vec_id", "embedding").collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i, _ in rows])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (7000, 7001, 7002, 7003, 7004, 7007))
    assert (got[7005].n_links, got[7006].component_id) == (1, 7005)
    alone = got.pop(None)
    assert (alone.n_links, alone.component_id, alone.kept) == (0, None, True)
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert all(got[5000 + i].component_id == 0 for i in range(5))


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    df = spark.createDataFrame([(i, v) for i, v in vectors(2, 300)], "vec_id long, embedding array<double>")
    x = np.array([v for _, v in vectors(2, 300)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum() - len(x)
    assert 0.97 * true <= sum(r.n_links for r in pivots.near_duplicates(df, "vec_id", "embedding").collect()) <= true


@pytest.mark.parametrize("cosine", [0.92, 0.99])
def test_links_in_a_large_group_of_unequal_near_copies(spark, monkeypatch, cosine):
    """A third of the rows are near-copies with noise of their own: no link of theirs is lost, in blocks and beside other vectors."""
    monkeypatch.setattr(pivots, "BLOCK", 256)
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = np.sqrt(cosine) * unit(rng.normal(size=64)) + np.sqrt(1 - cosine) * unit(rng.normal(size=(1000, 64)))
    x = np.concatenate([hot, unit(rng.normal(size=(2000, 64)))]).astype(np.float32)
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    y = unit(x.astype(np.float64))
    true = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(x))] == true.tolist()
    assert sum(true) > 500_000 and {got[i].component_id for i in range(1000)} == {0}


def test_no_vectors(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_pipeline(spark, sf):
    import hashlib
    from collections import Counter

    import corpus_pipeline as p
    import public_tokenizers
    import tiktoken

    from ledgerloom.llm import bpe
    from ledgerloom.llm.shared import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(-9, None, None, None, None)], docs.schema))
    columns = docs.columns
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf), "test-stage"))
        if len(steps) <= len(p.STAGES):
            assert steps[-1].columns == columns
    raw, good, single, clean, mixed, ids = ([tuple(r) for r in x.collect()] if i < 5 else x.collect() for i, x in enumerate(steps))
    assert set(good) <= set(raw) and all(len(r[1].split()) >= 50 for r in good)
    alive = {i for i, _, c in brute([(r[0], r[1]) for r in good], 5, 80, 100) if i == c}
    assert sorted(r[0] for r in single) == sorted(alive)
    assert sorted(r[0] for r in clean) == sorted(alive)
    text = {r[0]: r[1] for r in clean}
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert Counter(r.doc_id for r in ids) == Counter(r[0] for r in mixed)
    for r in ids:
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_pipeline_drops_only_near_duplicates_where_ids_repeat(spark, sf):
    import corpus_pipeline as p

    words = lambda seed: " ".join(random.Random(seed).choice("abcdefghij") * 3 + str(i) for i in range(60))
    one, two, three, four = map(words, range(4))
    rows = [(1, one, "x"), (1, two, "x"), (1, three, "x"), (5, two + " more", "x"), (2, one, "x"), (None, three, "x"), (None, four, "x"), (None, four, "x"), (7, "", "x"), (7, None, "x"), (1, one, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted([(1, one, "x"), (1, two, "x"), (1, three, "x"), (None, four, "x"), (7, "", "x"), (7, None, "x")], key=str)
    for parts in (1, 4):
        assert sorted((tuple(r) for r in p.near_duplicates(spark, df.repartition(parts), sf).collect()), key=str) == want


def test_stage_results_outlive_later_stages(spark, sf):
    import corpus_pipeline as p

    docs, other = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    good, rest = p.quality_rules(spark, docs, sf), p.quality_rules(spark, other, sf)
    single = p.near_duplicates(spark, docs, sf)
    n = good.count(), rest.count(), single.count()
    p.source_mix(spark, docs, sf).count()
    p.near_duplicates(spark, other, sf).count()
    p.byte_bpe(spark, docs, sf)
    assert (good.count(), rest.count(), single.count()) == n


def test_run_keeps_what_others_read_and_drops_its_own(spark, sf):
    import corpus_pipeline as p
    from ledgerloom.llm.shared import held

    good = p.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    n, before = good.count(), set(held(spark))
    one, two = p.run(spark, sf), p.run(spark, sf)
    assert one.count() == two.count() and good.count() == n
    left = set(held(spark)) - before
    assert before <= set(held(spark)) and len(left) == 2 and all("pipeline-mixing-sources" in path for path in left)  # those that the results read


def test_pipeline_stages_take_clashing_columns_and_no_rows(spark, sf):
    import corpus_pipeline as p

    rnd = random.Random(12)
    text = lambda n: " ".join("".join(rnd.choice("etaoins") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    rows = [(i, text(80), "en", "s", 1, "clash") for i in range(20)] + [(50, None, None, None, None, None), (51, "", "en", "s", 0, "x"), (3, text(90), None, "t", 2, None)]
    names = ["position", "row", "id", "at", "taken", "spans", "base_spans", "clean", "kept", "level", "a", "b", "n", "first", "mixed id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs = docs.select("*", *(docs["extra"].alias(n) for n in names))
    for d in (docs, docs.limit(0)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert (out.count() > 0) == (d is docs)
        assert p.STAGES[-1][1](spark, d, sf).count() == d.count()
