"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of over HEAVY rows is dealt over SALTS keys of a join, if it is one of the SPOTS keys with most rows: any other
#: key has at most one row in SPOTS.
HEAVY, SALTS, SPOTS = 256, 64, 4096

_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its files give fewer tasks than there are cores (a small table, or one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and quotes in it included."""
    return df["`" + name.replace("`", "``") + "`"]


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only local sessions may leave it unset: theirs is in the warehouse."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that a lost executor costs no lineage."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    kept = spark.read.schema(df.schema).parquet(place)
    _places[kept] = place
    return kept


def forget(kept: DataFrame) -> None:
    """Deletes what ``checkpoint`` wrote for this table, which nothing may read any more."""
    place = _places.pop(kept, None)
    if place:
        spark = kept.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over all shuffle partitions, however small it is: for tasks whose work is in Python."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def spot(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPOTS)).cast("int")


def spot(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPOTS)).cast("int")


def hot_keys(counts: DataFrame, key: str, heavy: int | None = None) -> DataFrame | None:
    """The keys with over ``heavy`` rows (``HEAVY``), the ``SPOTS`` with most of them, so that they can be broadcast; None if there is none.

    ``counts``: key and n, the rows with it. Every key left out has at most one row in SPOTS.
    """
    found = counts.where((F.col("n") > (HEAVY if heavy is None else heavy)) & F.col(key).isNotNull()).orderBy(F.desc("n")).limit(SPOTS).select(key)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame, how: str = "inner", heavy: int | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``key``, where very many rows of ``many`` may have one key.

    Rows of such a key, and in a left join those of a null key, are dealt over ``SALTS`` keys by a hash of
    ``by``. ``counts``: key and n, the rows of ``many`` with it. ``heavy``: rows from which a key is dealt, more than
    ``HEAVY`` where rows are narrow.
    """
    hot = hot_keys(counts, key, heavy)
    dealt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    if hot is None:
        if how == "inner":
            return many.join(one, key)
        apart = many.withColumn("_salt", F.when(F.col(key).isNull(), dealt).otherwise(0))
        return apart.join(one.withColumn("_salt", F.lit(0)), [key, "_salt"], how).drop("_salt")
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    apart = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), dealt).otherwise(0)).drop("_hot")
    copies = one.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return apart.join(copies, [key, "_salt"], how).drop("_salt")


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.octet_length(F.coalesce(column, F.lit(""))).cast("long")
