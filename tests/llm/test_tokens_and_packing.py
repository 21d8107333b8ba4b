import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing as pk
from quarry.llm import token_counts as tc
from quarry.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
FILE = tc.vocabulary("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "<|endoftext|>", "é", "日本", "1", "23", "!", "...", "İ", "ß", "😀", "\x1c", "\x85", "\r\n", "x<|endof", "́", "٣", "_", "the", " The", " "]
EDGE = [None, "", " ", "\n", "  a", "a  ", "<|endoftext|>", "a<|endoftext|> b", "x" * 30_000, "a " * 30_000, "ab\n" * 9_000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


def some_texts(n=4000):
    rnd = random.Random(3)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_are_those_of_the_library(library):
    own = tc.Counter(FILE)
    for text in [*some_texts(), *EDGE]:
        assert own.count(text) == len(ids_of(library, text)), repr(text)[:80]


def test_slices_and_full_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tc, "SLICE_CHARS", 40)
    monkeypatch.setattr(tc, "MAX_CACHED", 50)
    own = tc.Counter(FILE)
    for i in range(60):
        text = " ".join(some_texts(60)[i % 30 :])
        assert own.count(text) == len(ids_of(library, text))


def test_count_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("mine")).withColumn("over_limit", F.lit(0))
    got = tc.count_tokens(df, limit=1)
    assert got.columns == ["doc_id", "text", "n_tokens", "over_limit", "n_bytes", "n_tokens_", "over_limit_"]
    assert sorted((r["n_bytes"], r["n_tokens_"], r["over_limit_"]) for r in got.collect()) == [(0, 0, False), (3, 2, True), (3, 2, True)]
    assert tc.count_tokens(df.limit(0)).count() == 0


def test_ids_are_those_of_the_library(library, monkeypatch):
    own = pk.Encoder(FILE)
    texts = [x or "" for x in [*some_texts(1500), *EDGE]]
    expected = [np.asarray(ids_of(library, t), "<u4").tobytes() for t in texts]
    assert own.encode(texts) == expected
    monkeypatch.setattr(pk, "MAX_CACHED", 100)
    assert pk.Encoder(FILE).encode(texts) == expected


def test_cuts():
    for n in range(1, 3000):
        pieces = pk.cuts(n)
        assert sum(pieces) == n and max(pieces) <= 1024 and pieces.count(1024) >= n // 1024
        for length in pieces[:-1]:
            assert 1024 - 1024 // length * length < 16 or 1024 // (1024 // length) == length
        assert len(pieces) - n // 1024 <= 4


def test_classes_fill_with_a_fixed_count():
    packer = pk.Packer()
    for i in range(2):
        assert packer.add(341, i) is None
    assert [x[1] for x in packer.add(340, 2)] == [0, 1, 2]
    assert packer.add(1024, 9) == [(1024, 9)]
    for length in (500, 300, 200, 100, 20):
        packer.add(length, length)
    bins = packer.finish()
    assert all(sum(x[0] for x in b) <= 1024 for b in bins) and sum(len(b) for b in bins) == 5 and len(bins) == 2


def checked(pieces, texts, library, capacity=1024):
    """Every id in exactly one piece, offsets gapless; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, rs in by_doc.items():
        expected = [*ids_of(library, texts[doc]), 0]
        rs.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs[:-1]]).tolist()
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rs]).tolist() == expected
        assert {r["doc_tokens"] for r in rs} == {len(expected)}
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs[:-1]]).tolist()
        assert sum(r["length"] for r in rs) <= capacity
    return 1 - sum(r["length"] for r in pieces) / (capacity * len(by_sequence))


def test_packing(spark, library, words):
    texts = dict(enumerate([*EDGE, *(" ".join(words(n, seed=n)) for n in range(5, 900, 9))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(2)
    packed = pk.pack(df)
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert checked(rows, texts, library) < 0.02
    again = {(r["doc_id"], r["start"]): r["sequence_id"] for r in pk.pack(df).collect()}
    assert again == {(r["doc_id"], r["start"]): r["sequence_id"] for r in rows}
    whole = pk.sequences(packed).collect()
    assert {len(r["ids"]) for r in whole} == {4096}
    assert pk.pack(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in pk.pack(df).collect()) == [(0, 2), (0, 2), (3, 1)]


def test_queries(spark, data, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op8_token_counts"](spark, data).collect():
        n = len(ids_of(library, docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), n, n > 512)
    for r in QUERIES["op7_packing"](spark, data).collect():
        ids = np.asarray([*ids_of(library, docs[r["doc_id"]]), 0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
