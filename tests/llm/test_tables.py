"""Vector codes and the conversation trie against brute force, and queries against their SQL."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, same

from ledgerloom.llm import codes, trie
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op12_codes", "op13_trie"])
def test_query_equals_sql(spark, name):
    at = "/root/testdata/sf0.01"
    same(QUERIES[name](spark, at), connect(at), ORACLE_SQL[name])


def books_of(rows):
    rows = sorted((i is None, i or 0, v, i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    rows = [r[3:] for r in rows]
    w = len(rows[0][1]) // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    seeds = [r for r in rows if r[0] is not None][:16]
    books = [[cut(r[1], p) for r in seeds] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(8)] for _, v, _ in rows]
    for _ in range(6):
        got = assign()
        for p in range(8):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, x in zip(rows, got) if x[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got, by_label = assign(), defaultdict(int)
    for r, x in zip(rows, got):
        by_label[r[2]] += sum(t[0] for t in x)
    sha = hashlib.sha256(",".join(str(n) for b in books for e in b for n in e).encode()).hexdigest()
    return sorted(((r[0], "".join("%02x" % t[1] for t in x), sum(t[0] for t in x), by_label[r[2]], sha) for r, x in zip(rows, got)), key=str)


KIND = "vec_id long, embedding array<double>, label int, code string"


def encoded(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], KIND)
    return sorted((tuple(r) for r in codes.encode(df, "vec_id", "embedding", "label").collect()), key=str)


def test_codes_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [round(rnd.gauss(0, 1), 1) for _ in range(16)], rnd.choice((1, 2, None))) for i in range(150)]  # many ties
    rows += [(5, rows[5][1], 1), (None, rows[7][1], 2), (900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.nan] * 16, 1), (903, [math.inf] * 16, 2)]
    assert encoded(spark, rows) == books_of(rows)


def test_large_components(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((1e-3, 1.0, 3e4, 1e9)) * rnd.gauss(0, 1) for _ in range(8)], 1) for i in range(40)]
    got = encoded(spark, rows)
    assert [r[:2] for r in got] == [r[:2] for r in books_of(rows)]
    assert {r[4] for r in got} == {r[4] for r in books_of(rows)}
    assert len(encoded(spark, [(1, [1e308] * 8, 1), (2, [-1e308] * 8, 1)])) == 2


def test_codes_of_odd_tables(spark):
    assert encoded(spark, []) == []
    assert encoded(spark, [(1, [1.0] * 8, 3), (2, [1.0] * 16, 3), (3, [], 4)])[1][1:4] == (None, None, 0)
    assert encoded(spark, [(1, [1.0] * 7, 3)])[0][1:4] == (None, None, None)


def test_screening_keeps_the_nearest():
    rnd = np.random.default_rng(6)
    for top in (3, 1 << 12, 1 << 26, 1 << 40):
        x, book = rnd.integers(-top, top, (500, 8)), rnd.integers(-top, top, (16, 8))
        far = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert (codes.nearest(x, book) == np.array([min(range(16), key=lambda e: (r[e], e)) for r in far])).all()


def nodes_of(rows, spliced):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [v[2:] for v in sorted(turns)] for c, turns in conv.items()}
    full = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 9 if spliced else 0
        full[c] = conv.get(c - c % 5, [])[:h] + turns[h:]
    members, children, totals, out = defaultdict(list), defaultdict(list), {}, []
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n in sorted(members, key=len, reverse=True):
        m, own = members[n], (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        totals[n] = (sum(totals[k][0] for k in children[n]) or 1, own + sum(totals[k][1] for k in children[n]))
        ends = ",".join(str(c) for c in m if len(full[c]) == len(n))
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), *totals[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def talks():
    rnd = random.Random(7)
    rows = []
    for c in range(60):
        for t in range(rnd.choice((1, 2, 4, 9, 14))):
            rows.append((c, rnd.choice((t, t, None, 3)), rnd.choice(("user", "assistant", None)), rnd.choice(("", "a", "é", None, "bb"))))
    rows += [(100 + c, t, "user", f"same {t}") for c in range(30) for t in range(6)]  # copies
    rows += [(200 + c, t, "user", f"longer {t}") for c in range(12) for t in range(c + 1)]  # each one begins the next
    rows += [(301, t, "user", "x" * (t % 3)) for t in range(700)] + [(None, 1, "user", "lost"), (302, 1, "user", "twice"), (302, 1, "user", "twice")]
    return rows


@pytest.mark.parametrize("spliced", [False, True])
def test_trie_equals_brute_force(spark, spliced):
    rows = talks()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted(tuple(r) for r in trie.conversation_trie(df, "conv_id", "turn", "role", "text", spliced=spliced).collect())
    assert got == nodes_of(rows, spliced)


def test_trie_of_one_long_conversation_spreads(spark):
    rows = [(7, t, "user", str(t * t % 7)) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = trie.ordered_turns(df, "conv_id", "turn", "role", "text")
    assert turns.rdd.getNumPartitions() > 1
    assert sorted(r.i for r in turns.select("i").collect()) == list(range(1, 3001))
    got = sorted(tuple(r) for r in trie.conversation_trie(df, "conv_id", "turn", "role", "text").collect())
    assert got == nodes_of(rows, False)


def test_trie_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(df, "conv_id", "turn", "role", "text", spliced=True).count() == 0
