"""The item source: opening, checking, and what is derived from each item's file list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("infohash", T.StringType()),
        T.StructField("magnet", T.StringType()),
        T.StructField("files", T.StringType()),
        T.StructField("total_size", T.LongType()),
        T.StructField("fetched_at", T.LongType()),
    ]
)
FILES = "array<struct<path:string,size:double>>"
#: Files that a stored preview holds, and that a served one shows.
PREVIEW_FILES, SHOWN_FILES = 8, 5


class SourceError(ValueError):
    """The source cannot be used as it is."""


def check_schema(source: DataFrame, required: T.StructType = ITEM_SCHEMA) -> DataFrame:
    """``source`` itself; SourceError naming every missing column, for an empty table too."""
    missing = [f.name for f in required.fields if f.name not in source.columns]
    if missing:
        raise SourceError(f"the source lacks the columns: {', '.join(missing)}")
    return source


def open_source(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The source at ``path``, checked. It is only read, and never created."""
    try:
        return check_schema(spark.read.format(form).load(path))
    except AnalysisException as e:
        raise SourceError(f"no source at {path}") from e


def spread(source: DataFrame) -> DataFrame:
    """``source``, dealt over all cores if its files give fewer tasks than there are cores (one row group is one task)."""
    spark = source.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return source if source.rdd.getNumPartitions() >= cores else source.repartition(cores)


def extent(source: DataFrame, key: str = "id") -> tuple[int, int] | None:
    """Smallest and largest id; None for an empty table."""
    low, high = source.agg(F.min(key), F.max(key)).first()
    return None if low is None else (low, high)


def sized_extent(source: DataFrame, key: str = "id") -> tuple[int, int, int] | None:
    """Smallest and largest id, and the number of rows; None for an empty table."""
    low, high, n = source.agg(F.min(key), F.max(key), F.count(key)).first()
    return None if low is None else (low, high, n)


def since(source: DataFrame, watermark: int | None, upto: int | None = None, key: str = "id") -> DataFrame:
    """Rows after the watermark, up to an id fixed beforehand; both filters reach the scan."""
    out = source
    if watermark is not None:
        out = out.where(F.col(key) > watermark)
    if upto is not None:
        out = out.where(F.col(key) <= upto)
    return out


def parsed_files(files: Column) -> Column:
    """The (path, size) list in a JSON text: of an array, or of one object; null if it is no JSON.

    Paths must be strings and not empty. Sizes may be numbers or numeric strings; else they are 0.
    """

    # VARIANT keeps a path's type, which a typed parse would lose. What is no object becomes null.
    file = "struct<path:variant,size:double>"

    def one(x: Column) -> Column:
        text = F.when(F.schema_of_variant(x["path"]) == "STRING", F.try_variant_get(x["path"], "$", "string"))
        return F.struct(text.alias("path"), F.nanvl(F.coalesce(x["size"], F.lit(0.0)), F.lit(0.0)).alias("size"))

    def listed(whole: Column) -> Column:
        array = F.try_variant_get(whole, "$", f"array<{file}>")
        items = F.coalesce(array, F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.array(F.try_variant_get(whole, "$", file))), F.array().cast(f"array<{file}>"))
        return F.when(whole.isNotNull(), F.filter(F.transform(items, one), lambda f: F.coalesce(f["path"], F.lit("")) != "")).cast(FILES)

    # An array of one, so that a text is parsed once however often it is looked at.
    return F.transform(F.array(F.try_parse_json(files)), listed)[0]


def with_file_facts(source: DataFrame, files: str = "files") -> DataFrame:
    """``source`` with file_list, file_count, body (the paths, one a line) and preview.

    A text that is no JSON counts as the body itself, with no files.
    """
    parsed = source.withColumn("file_list", parsed_files(F.col(files)))
    paths = F.col("file_list")["path"]
    nothing = F.array().cast(FILES)
    return parsed.select(
        *source.columns,
        F.coalesce("file_list", nothing).alias("file_list"),
        F.coalesce(F.size("file_list"), F.lit(0)).cast("int").alias("file_count"),
        F.coalesce(F.when(F.col("file_list").isNull(), F.col(files)).otherwise(F.array_join(paths, "\n")), F.lit("")).alias("body"),
        F.coalesce(F.slice("file_list", 1, PREVIEW_FILES), nothing).alias("preview"),
    ).withColumn("file_count", F.when(F.col("file_count") < 0, 0).otherwise(F.col("file_count")))


def picked_preview(preview: Column, words: list[str], shown: int = SHOWN_FILES) -> Column:
    """The files of a stored preview to show: with words, those that hold any, most words first; at most ``shown``."""
    if not words:
        return F.slice(preview, 1, shown)

    def scored(f: Column, i: Column) -> Column:
        low = F.lower(f["path"])
        n = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        return F.struct((-n).alias("rank"), i.alias("place"), f.alias("file"))

    hits = F.filter(F.transform(preview, scored), lambda s: s["rank"] < 0)
    return F.slice(F.transform(F.array_sort(hits), lambda s: s["file"]), 1, shown)


@dataclass(frozen=True)
class Changes:
    """What a refresh of stored file lists has to write."""

    new: DataFrame
    changed: DataFrame


def fingerprinted(source: DataFrame, files: str = "files") -> DataFrame:
    return source.withColumn("fingerprint", F.xxhash64(F.coalesce(F.col(files), F.lit(""))))


def file_changes(source: DataFrame, stored: DataFrame) -> Changes:
    """Rows of ``source`` that the store lacks, and those whose file text differs from the stored one's fingerprint."""
    now = fingerprinted(source)
    both = now.join(stored.select("id", F.col("fingerprint").alias("stored")), "id", "left")
    return Changes(both.where("stored is null").drop("stored"), both.where("stored <> fingerprint").drop("stored"))
