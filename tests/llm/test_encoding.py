"""BPE, Simple-8b and token files against the libraries and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, simple8b, tokenfiles
from ledgerloom.llm.shared import new_path

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", " ", "  ", "\n", "\t", "é", "'s", "1", "²", "漢", "_", "!", "\x1c", "\x85", "😀", "Ab", "the", " \n", "'ll", "<|endoftext|>"]


def texts(n=400, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", "x" * 5000, "ab " * 30000, "".join(rnd.choice("abcdefgh") for _ in range(20000))]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_ids_equal_the_library(spark, own):
    rows = [(i, t, 7, b"x") for i, t in enumerate(texts())] + [(-1, None, 7, b"x"), (-1, None, 7, b"x"), (None, "null id", 7, b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, ids binary")
    ids = bpe.encode(df, "doc_id", "text", RANKS, P.PATTERN)
    got = bpe.decode(ids, "doc_id", "ids", RANKS).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text[r.doc_id])
        assert bytes(r.decoded) == text[r.doc_id].encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, "doc_id", "text", RANKS, P.PATTERN), "doc_id", "ids", RANKS).count() == 0


def test_short_and_long_trees_agree():
    ranks, rnd = bpe.load_ranks(RANKS), random.Random(3)
    words = ["".join(rnd.choice("etaoinshré ") for _ in range(rnd.randrange(31))).encode() for _ in range(2000)] + [bytes([200] * n) for n in range(60)]
    words = [w for w in words if len(w) <= bpe.ShortPieces.LONGEST and w not in ranks]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.ShortPieces(ranks)(words)] == [bpe.merge(w, ranks) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(1, 60), st.data())
def test_words_round_trip(values, repeats, data):
    own = np.array(values * repeats, np.uint64)
    block = simple8b.pack(own)
    assert simple8b.unpack(block).tolist() == own.tolist()
    a = data.draw(st.integers(0, len(own)))
    b = data.draw(st.integers(a, len(own)))
    assert simple8b.unpack(block, a, b).tolist() == own[a:b].tolist()


def test_zeros_are_small():
    assert len(simple8b.pack(np.zeros(12000))) < 1000


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(150))] + [(1, None), (1, None), (2, "two")]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).repartition(5)
    path = new_path(spark, "test-tokens")
    tokenfiles.write(df, "doc_id", "text", path, lambda: tokenfiles.library_encoder(VOCABULARY, P.PATTERN), end_id=2)
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    wanted, start = [], 0
    for i, t in sorted((i, t or "") for i, t in rows):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfiles.read(spark, path, "doc_id").select("doc_id", "start", "n_tokens", tokenfiles.checksum(F.col("ids"))).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_token_file_query_equals_the_library_as_loaded(spark, tmp_path):
    from ledgerloom.llm.queries import QUERIES

    own = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n<|endoftext|", "<|endoftext|> é 漢 " * 50, "<|ENDOFTEXT|>", "plain text", "", None]
    rows = [(i, t) for i, t in enumerate([*own, *texts(80, 7)])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(VOCABULARY)
    wanted, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert wanted[0][2] == 5
    assert sorted(map(tuple, QUERIES["op5_token_files"](spark, str(tmp_path)).collect())) == wanted


def test_no_token_files(spark):
    path = new_path(spark, "test-tokens")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", path, lambda: tokenfiles.library_encoder(VOCABULARY, P.PATTERN), end_id=2)
    assert tokenfiles.read(spark, path, "doc_id").count() == 0


def test_pieces_go_to_the_model_alone():
    """The library's model gives what the library gives, bytes and odd pieces included, and other kinds of tokenizers aren't taken for such."""
    import json

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    from ledgerloom.llm import tokenfiles

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces = [" the", "naïve", "\n\n", "\t", " ", "日本語", "🙂", "\x00", "a" * 500, "<|", "endoftext", "'s", " 12345", "­", "\x7f", "é"]
    wanted = [np.array(own.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert tokenfiles._by_model(own)(pieces) == wanted
    own.normalizer = normalizers.Lowercase()
    assert json.loads(own.to_str())["normalizer"] and tokenfiles._by_model(own) is None


def test_token_files_are_read_without_a_shuffle(spark, tmp_path):
    """Blocks know how many ids are before them, so they go nowhere; starts run on over blocks and buckets."""
    rows = [(i, "ab " * (i % 7 if i % 30 else 40_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "tokens")
    encoder = lambda: lambda texts: [np.frombuffer(t.encode(), np.uint8).astype("<u4").tobytes() for t in texts]
    tokenfiles.write(df, "doc_id", "text", path, encoder, end_id=2, buckets=2)
    assert spark.read.parquet(f"{path}/blocks").groupBy("bucket").count().where("count > 1").count() == 2
    got = tokenfiles.read(spark, path, "doc_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    start = 0
    for r, (i, t) in zip(sorted(got.collect()), rows):
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(t) + 1)
        start += r.n_tokens


def test_pieces_with_the_separator():
    """U+FFFF stands between pieces on their way to the library; texts that hold it come out as the library's own."""
    own = Tokenizer.from_file(VOCABULARY)
    for texts in (["a￿b", "￿", "x ￿￿ y é"], ["plain", " é ü", ""]):
        got = tokenfiles.library_encoder(VOCABULARY, P.PATTERN)(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_split_whole_batches(monkeypatch):
    """The encoder of token files doesn't split text by text (that cost more than its budget), and gives the library's ids."""
    from ledgerloom.llm.pieces import PieceEncoder

    def split(*_):
        raise AssertionError("a text is split by itself")

    monkeypatch.setattr(PieceEncoder, "split", split)
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    for batch in ([], [""], ["", "", " "], ["it's", "'s", "x" * 500 + " é", ""], texts(120, 3)):
        got = tokenfiles.library_encoder(VOCABULARY, P.PATTERN)(batch)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in batch]


def test_starts_are_those_of_the_pattern():
    import regex

    from ledgerloom.llm import pieces

    assert pieces.RUNS == P.PATTERN
    full, rng = regex.compile(P.PATTERN), random.Random(11)
    odd = [*"'''''stmdrevlSTa     \n\n\t\r\x0b\x1c\x1f01!_-#\x00\x7f", "\x85", "\xa0", " ", "　", "​", "\xad", "٣", "\xb2", "Ⅷ", "é", "漢", "ß", "ʼ", "’", "क्", "🙂", "𝒳", "𝟘", "\U000e0100", "￿", "\U0010ffff"]
    own = ["", *("".join(rng.choices(odd, k=rng.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(20_000)), *(chr(i) + "'s " + chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000)]
    data = pieces._STOP.join([*(t.encode() for t in own), pieces._STOP])
    at = pieces.starts(data).tolist()
    wanted = [p for t in own for p in (*(x.encode() for x in full.findall(t)), pieces._STOP)]
    assert [data[a:b] for a, b in zip(at, at[1:])] == wanted


def test_pooled_pieces_are_bounded():
    """Very long pieces aren't kept, a full store is emptied, and other patterns are split text by text; ids stay the same."""
    from ledgerloom.llm.pieces import PooledEncoder

    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [np.frombuffer(p.encode(), np.uint8).astype("<u4").tobytes() for p in pieces]

    batches = [["a b a", "", "c" * 300], ["c" * 300 + " b", "d e f g"], ["a b", "h"], ["a"]]
    for pattern in (P.PATTERN, r"\w+|\W+"):
        pooled = PooledEncoder(pattern, encode, capacity=4)
        for batch in batches:
            assert [np.frombuffer(x, "<u4").tolist() for x in pooled(batch)] == [list(t.encode()) for t in batch]
    pooled, asked[:] = PooledEncoder(P.PATTERN, encode), []
    for batch in batches:
        pooled(batch)
    assert asked.count("c" * 300) == 2 and asked.count(" b") == 1
    assert len(pooled._pool) < 20 and len(pooled._ends) == len(pooled._place) + 1
