"""Corpus pipeline: stages that each call one operator of ``quarry.llm``.

Every stage takes the documents that its predecessor kept. Toxic documents go, then those that
the quality rules reject, then all but one of each group of near-duplicates, then those that
overlap the benchmark; what is left is packed into sequences. No stage is expressible in SQL
as a whole (the first fits a classifier, the last encodes tokens), so ORACLE_SQL is None and
the tests hold the result against brute force.

What a stage keeps is written once, to the shared folder, before the next one reads it, so
nothing is computed twice.

Defined results: rows with a null text are empty texts, which the quality rules reject; of rows that
repeat (one id, one text) one stays; rows with a null id are linked with nothing; very long texts are
taken whole; all columns of the documents pass through the filtering stages; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, spread, table
from quarry.llm.decontamination import decontaminate
from quarry.llm.near_dedup import near_duplicates
from quarry.llm.packing import pack
from quarry.llm.quality_rules import apply_rules
from quarry.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It is fitted on the labelled ones among ``docs``."""
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass."""
    judged = apply_rules(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    found = near_duplicates(docs, k=5, threshold=0.8)
    left = docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), short=True, by_row=True).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        docs = kept if name == STAGES[-1][0] else checkpoint(kept)
    return docs
