"""The inverted index as DataFrames: postings, document and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import index_tokens

FIELDS = ("name", "body")


def postings(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """term, field, id, tf: how often each term stands in each field of each item.

    Every text is tokenised once, where it is read; the shuffle holds one row a term, field and item.
    """

    def named_tokens(f: str) -> Column:
        return F.transform(index_tokens(F.col(f)), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))

    named = [named_tokens(f) for f in fields]
    exploded = items.select("id", F.explode(F.concat(*named)).alias("t")).select("id", "t.field", "t.term")
    return exploded.groupBy("id", "field", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "field", "id", "tf")


def item_postings(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The same rows without a shuffle, from rows of one item each: an item's tokens are sorted and its runs of equal ones counted where it is read."""

    def counted(f: str) -> Column:
        def runs(own: Column) -> Column:  # places from 1 on
            first = F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: (i > 0) & ((i == 1) | (F.get(own, i - 1) != F.get(own, i - 2))))
            return F.transform(F.array(first), lambda at: F.transform(at, lambda i, k: run(own, i, F.coalesce(F.get(at, k + 1), F.size(own) + 1))))[0]

        def run(own: Column, i: Column, end: Column) -> Column:
            return F.struct(F.get(own, i - 1).alias("term"), F.lit(f).alias("field"), (end - i).cast("int").alias("tf"))

        # An array of one, so that a text is tokenised once however often its tokens are looked at.
        return F.transform(F.array(F.sort_array(index_tokens(F.col(f)))), runs)[0]

    return items.select("id", F.explode(F.concat(*map(counted, fields))).alias("t")).select("t.term", "t.field", "id", "t.tf")


def length(fields: tuple[str, ...] = FIELDS) -> Column:
    """Tokens over all fields."""
    return sum((F.size(index_tokens(F.col(f))) for f in fields), F.lit(0)).cast("long")


def doc_stats(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id and dl, the number of tokens over all fields, of every item."""
    return items.select("id", length(fields).alias("dl"))


def term_rows(found: DataFrame) -> DataFrame:
    """term and n: the rows that each term has in postings."""
    return found.groupBy("term").agg(F.count("*").alias("n"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs and total_dl. Rows of parts of a corpus add up."""
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"))


@dataclass(frozen=True)
class Index:
    """docs (narrow copies), postings, doc_stats, corpus (rows of n_docs and total_dl) and terms of a set of items."""

    docs: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    corpus: DataFrame
    #: term and n, its rows in postings (or more); without it, all terms of a query are gathered.
    terms: DataFrame | None = None


def build(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> Index:
    """An index that is computed whenever it is used; write its parts to keep them."""
    stats = doc_stats(items, fields)
    return Index(items, postings(items, fields), stats, corpus_stats(stats))
