"""Sharding by a two-pass external shuffle (operator 5), DataFrame functions only.

Pass 1 scatters the records uniformly into buckets that fit in memory, by a seeded hash of
the whole record. Pass 2 loads each bucket, shuffles it by Fisher-Yates (the engine's
``shuffle`` function) and lays the buckets end to end: the place of a record in that line is
its position. Shards are equal ranges of positions, so their row counts differ by one at
most (law ``rows``), and no group of records, copies of one text included, can make a shard
larger.

A repeated task makes the same order again: rows reach ``shuffle`` sorted by bucket, hash and
copy within a partition of fixed number, and the seed is fixed. Rows that are equal in every
column are interchangeable. Very many of them (over ``HEAVY``) do not meet in one bucket: they are
counted, dealt anew as copies with a number each, and the number takes part in the hash.

Defined results: null ids and null texts are values like others; an empty table gives an
empty result; a very long text is a record like others (its bucket is larger by it); repeated rows
get a slot each; all columns pass through, and the new ones give
way (``shard_``) where a column of that name exists. Columns of types that cannot be hashed
(maps, variants) are hashed as JSON.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from quarry.llm import common
from quarry.llm.common import column, free_name, spot, text_bytes

#: UTF-8 bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Rows that a bucket holds on average, whatever their size.
BUCKET_ROWS = 200_000
#: Copies of a row that are dealt at once; buckets that are numbered together.
CHUNK, BLOCK = 4096, 4096


def _plain(kind: T.DataType) -> bool:
    """Whether values of a type can be hashed and grouped."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    return kind.typeName() not in ("map", "variant")


def _scattered(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """bucket, h, copy and record of every row: uniform over the buckets, whatever repeats."""
    values: list[Column] = [column(docs, f.name) if _plain(f.dataType) else F.to_json(F.struct(column(docs, f.name))) for f in docs.schema]
    rows = docs.select(F.xxhash64(F.lit(seed), *values).alias("h"), F.struct(*values).alias("values"), F.struct(*(column(docs, c) for c in docs.columns)).alias("record"))
    hot = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > common.HEAVY)
    hot = F.broadcast(hot.select(spot("h").alias("spot"), F.lit(True).alias("hot")).distinct())  # SPOTS rows at most
    marked = rows.withColumn("spot", spot("h")).join(hot, "spot", "left")
    single = marked.where("hot is null").select(F.pmod("h", F.lit(buckets)).alias("bucket"), "h", F.lit(0).cast("long").alias("copy"), "record")
    counted = marked.where("hot").groupBy("h", "values").agg(F.first("record").alias("record"), F.count("*").alias("n"))
    chunks = counted.select("h", "record", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk")).repartition("h", "chunk")
    copies = chunks.select("h", "record", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("copy"))
    return single.unionByName(copies.select(F.pmod(F.xxhash64("h", "copy"), F.lit(buckets)).alias("bucket"), "h", "copy", "record"))


def _firsts(scattered: DataFrame) -> DataFrame:
    """bucket and first: how many rows the buckets before it hold. Buckets are added up by block, then inside it."""
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {BLOCK}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).select("block", (F.sum("n").over(before) - F.col("n")).alias("ahead"))  # one row for 4096 buckets
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("own", F.sum("n").over(inside) - F.col("n")).join(blocks, "block").select("bucket", (F.col("ahead") + F.col("own")).alias("first"))


def external_shuffle(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20_260_101,
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` in a seeded random order: with position (gapless), shard and slot (gapless in it)."""
    position, shard, slot = (free_name(docs, x) for x in ("position", "shard", "slot"))
    total = docs.agg(F.count("*").alias("n"), F.sum(text_bytes(column(docs, text)) + 1).alias("b")).first()
    rows = max(1, total["n"])
    buckets = max(1, math.ceil((total["b"] or 0) / bucket_bytes), math.ceil(rows / bucket_rows))

    scattered = _scattered(docs, seed, buckets)
    sizes = _firsts(scattered)
    whole = scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "h", "copy").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    shuffled = whole.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    placed = shuffled.join(sizes, "bucket").select((F.col("first") + F.col("at")).alias(position), "record")
    share = F.expr(f"(({position} + 1) * {shards} - 1) div {rows}")
    out = placed.select("record.*", position, share.cast("int").alias(shard))
    return out.withColumn(slot, F.col(position) - F.expr(f"({shard} * {rows}L) div {shards}"))


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder of Parquet files a shard, rows in the order of their slots."""
    shuffled.sortWithinPartitions(shard, slot).write.partitionBy(shard).mode("overwrite").parquet(path)
