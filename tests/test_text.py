import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as fn


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_folding_is_that_of_the_index_engine(spark):
    """Against the tokeniser of SQLite's full-text index, for every letter that has a lower-case form of one character."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    letters = [c for c in map(chr, range(0x80, 0x2000)) if c.isalpha() and len(c.lower()) == 1]
    con.executemany("insert into t(rowid, x) values (?, ?)", [(ord(c), c) for c in letters])
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    expected = {d: t for t, d in con.execute("select term, doc from v")}
    df = spark.createDataFrame([(ord(c), c) for c in letters], "id int, x string")
    got = {r[0]: r[1] for r in df.select("id", fn.fold(F.col("x"))).collect()}
    differing = {chr(k) for k in expected if got[k] != expected[k]}
    assert len(differing) <= 170  # case pairs newer than that engine's tables
    assert all(ord(c) >= 0x37F for c in differing)


def test_tokens(spark):
    assert one(spark, "The Cat_sat, 2x 日本 é", fn.tokens) == ["the", "cat", "sat", "2x", "日本", "é"]
    assert one(spark, "Élan é", fn.index_tokens) == ["elan", "e"]
    assert one(spark, None, fn.tokens) == []
    assert one(spark, " 高清Movie1080p!", fn.fallback_words) == ["高", "清", "movie1080p"]


@pytest.mark.parametrize("given, out", [("  WORD ", "word"), ("...", ""), (None, ""), ("é", "é"), ("a b", "a b")])
def test_normalized_keyword(spark, given, out):
    assert one(spark, given, fn.normalized_keyword) == out


def test_hashes(spark):
    assert one(spark, "magnet:?xt=urn:btih:AB-12 cd", fn.normalized_hash) == "ab12cd"
    for text, yes in (("a" * 40, True), ("HASH" + "b" * 40, True), ("x urn:btih:" + "0" * 40, True), ("g" * 40, False), ("a" * 39, False)):
        assert one(spark, text, fn.is_hash) is yes


@pytest.mark.parametrize("name, label", [("a.MKV", "video"), (".gitignore", "other"), ("x.", "other"), ("a.b.zip", "archive"), ("a\nb.flac", "audio"), ("png", "other"), ("dir.mkv/x", "other"), ("y.jpg", "image")])
def test_category(spark, name, label):
    assert one(spark, name, fn.category) == label


def test_display(spark):
    for n, s in ((0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (103552, "101.13 KB"), (8589934592, "8.00 GB"), (2**50, "1024.00 TB"), (None, "-"), (-1, "-")):
        assert one(spark, n, fn.format_bytes, "long") == s
    assert one(spark, 1700000000000, fn.format_date, "long") == "2023-11-14 22:13"
    assert one(spark, None, fn.format_date, "long") == "-"
    assert one(spark, 1234567, fn.format_count, "long") == "1,234,567"
    for ms, s in ((65000, "01:05"), (3661000, "1:01:01"), (-1, "-"), (None, "-")):
        assert one(spark, ms, fn.format_countdown, "long") == s
    assert one(spark, "m", fn.thunder_link) == "thunder://QUFtWlo="
    assert one(spark, None, fn.thunder_link) == ""


def test_highlight(spark):
    assert one(spark, "A & amp <b>", lambda c: fn.highlight(c, ["amp", "a"])) == "<mark>A</mark> &amp; <mark>amp</mark> &lt;b&gt;"
    assert one(spark, "x'y\"", lambda c: fn.highlight(c, [])) == "x&#39;y&quot;"
    assert one(spark, None, lambda c: fn.highlight(c, ["a"])) == ""
    assert one(spark, "a.b axb", lambda c: fn.highlight(c, ["a.b"])) == "<mark>a.b</mark> axb"


def test_natural_order(spark):
    names = ["e10", "e9", "E1", "f"]
    df = spark.createDataFrame([(n,) for n in names], "x string").orderBy(fn.natural_key(F.col("x")))
    assert [r[0] for r in df.collect()] == ["E1", "e9", "e10", "f"]


def test_size_buckets(spark):
    for n, label in ((0, "<100MB"), (100 << 20, "100MB-1GB"), ((1 << 30) - 1, "100MB-1GB"), (100 << 30, ">100GB"), (None, None)):
        assert one(spark, n, fn.size_bucket, "long") == label
