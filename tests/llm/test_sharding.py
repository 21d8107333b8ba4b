import zlib
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import sharding
from quarry.llm.queries import QUERIES


def table_of(spark, n=500):
    rows = [(i, "same" if i % 3 == 0 else None if i % 50 == 1 else f"text {i} é" * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_row_once_in_even_shards(spark):
    df = table_of(spark)
    got = sharding.external_shuffle(df, 16, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(map(tuple, df.collect()))
    assert sorted(r["position"] for r in got) == list(range(500))
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_order_is_random_and_repeatable(spark):
    df = table_of(spark)
    order = lambda **x: [r["doc_id"] for r in sharding.external_shuffle(df, 4, **x).orderBy("position").collect()]
    once = order()
    assert once == order() and once != order(seed=2)
    assert sum(a + 1 == b for a, b in zip(once, once[1:])) < 20
    # One bucket is shuffled too: its order is not that of the scattering hash.
    hashed = [r["doc_id"] for r in df.orderBy(F.xxhash64(F.lit(20_260_101), "doc_id", "text")).collect()]
    assert once != hashed
    thirds = [sum(once[i::3]) / (500 / 3) for i in range(3)]
    assert all(200 < t < 300 for t in thirds)


def test_few_rows_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sharding.external_shuffle(df, 16)
    assert got.columns == ["doc_id", "text", "shard", "m", "position", "shard_", "slot"]
    assert len({r["shard_"] for r in got.collect()}) == 3 and {r["slot"] for r in got.collect()} == {0}
    assert sharding.external_shuffle(df.limit(0), 16).count() == 0


def test_equal_rows_are_dealt_over_all_buckets(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "HEAVY", 20)
    monkeypatch.setattr(sharding, "CHUNK", 30)
    monkeypatch.setattr(sharding, "BLOCK", 3)
    rows = [(1, "same")] * 700 + [(None, None)] * 90 + [(i, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("s", F.struct("doc_id"))
    buckets = 20
    sizes = Counter(r["bucket"] for r in sharding._scattered(df, 1, buckets).collect())
    assert len(sizes) == buckets and max(sizes.values()) < 3 * len(rows) / buckets
    got = sharding.external_shuffle(df, 16, bucket_rows=50).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows) and got[0]["m"] == {"k": 1}
    assert sorted(r["position"] for r in got) == list(range(len(rows)))


def test_writing(spark, tmp_path):
    shuffled = sharding.external_shuffle(table_of(spark), 5)
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
    assert len(list((tmp_path / "out").glob("shard=*"))) == 5


def test_query(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op5_sharding"](spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
