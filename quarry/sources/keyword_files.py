"""Keyword lists as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normalized_keyword


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised terms of a text file: one a line; ``#`` lines, trailing ``# remarks`` and a BOM are dropped."""
    line = F.regexp_replace(F.col("value"), "^\\ufeff", "")
    term = normalized_keyword(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    return spark.read.text(path).select(term.alias("term")).where("term <> ''").distinct()


def write_keywords(terms: DataFrame, path: str, header: str = "# keywords") -> None:
    """Terms in order, one a line, after a header line. One file: the list is bounded by what people maintain by hand."""
    head = terms.sparkSession.createDataFrame([(header, 0)], "value string, part int")
    lines = head.unionByName(terms.select(F.col("term").alias("value"), F.lit(1).alias("part")))
    lines.orderBy("part", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_ascii_dump(stats: DataFrame, path: str) -> None:
    """term, doc_count and occurrences of printable-ASCII terms, most frequent first, tab-separated."""
    ascii_terms(stats).orderBy(F.desc("doc_count"), F.desc("occurrences"), "term").write.mode("overwrite").csv(path, sep="\t")


def ascii_terms(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("term").rlike(r"^[\x20-\x7e]+$")).select("term", "doc_count", "occurrences")
