"""Registered queries over whole small tables against brute force, where no SQL holds them."""

import hashlib
import re

import numpy as np
import pytest
from test_pairs import brute

from ledgerloom.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, sf, name, key="doc_id"):
    got = QUERIES[name](spark, sf).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def test_op1(spark, sf):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(table)
    x = np.array([table[i] / np.linalg.norm(table[i]) for i in ids])
    near = (x @ x.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], low.max()).min(axis=1))
        if (new == low).all():
            break
        low = new
    got = rows(spark, sf, "op1_embeddings", "vec_id")
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(axis=1), low)}


def test_op4(spark, sf, documents):
    import public_tokenizers
    import tiktoken

    from ledgerloom.llm import bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows(spark, sf, "op4_byte_bpe")
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        ids = own.encode_ordinary(text)
        assert tuple(got[i])[:4] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(spark, sf, documents):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    got = rows(spark, sf, "op6_secrets")
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(kinds) for m in p.finditer(text) if good(m))
        base = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[i].spans.split(","))


def test_op8(spark, sf, documents):
    got = rows(spark, sf, "op8_jaccard")
    assert sorted((i, r.n_shingles, r.component_id) for i, r in got.items()) == brute(sorted(documents.items()), 3, 90, 100)


def test_op9(spark, sf, documents):
    got = rows(spark, sf, "op9_quality")
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = {t for t in three if three.count(t) > 1} if len(three) < 3000 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == len(worded) - len(set(worded))
        if often is not None:
            assert r.n_repeat_words == len({j + k for j, t in enumerate(three) if t in often for k in range(3)})
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert any(r.kept for r in got.values())
