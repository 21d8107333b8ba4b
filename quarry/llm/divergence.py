"""Source divergence audit (operator 12): how far the word use of a language's sources differs.

Plain relations, step by step:

1. Regular-expression matches of every text are exploded: once each occurrence, once each
   distinct term of a document, so one aggregation gives a term's occurrences and documents in each
   (lang, source) group. Only partial sums by group and term are shuffled.
2. A language keeps its terms that are in at least ``least_docs`` documents; V of them.
3. Groups meet the kept terms of their language, so that a term which a group never uses counts 0.
   The language itself is one more group, the sum of its sources.
4. A group's share of a term is p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of kept terms.
5. ``pair``: groups of a language meet on (lang, term) and the values (p-q)^2/q are summed; ``term``: a
   group's terms over the language's share, the largest ``most_terms``.

Terms are runs of A-Z, a-z and all characters beyond ASCII; only A-Z are lower-cased. Counts times
10^9 are decimals, everything else fits 64 bits (the sum of a pair is at most the square of two shares' sums).

Step 3 joins on (lang, part of the vocabulary), a hash of the term, so that a language with most of the
data is dealt over ``PARTS`` keys; a pair's sum is partly made where its terms are. The ranking of terms
cuts each task's rows before they are shuffled. Nothing is collected or broadcast by hand.

Defined results: a null text, lang or source counts as ''; texts without terms add nothing, but their
group is there with counts of 0 (and pairs of value 0 if the language keeps no term at all); rows that repeat
are documents of their own; equal values rank by the item's UTF-8 bytes; of an empty table the result is empty;
only the three columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, column, forget

#: What stands between terms; a document frequency that keeps one; ranks that the ``term`` part shows.
BETWEEN, LEAST_DOCS, MOST_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 3, 200
UNIT = 1_000_000_000
#: A language's vocabulary is dealt over so many keys where groups meet it.
PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    # Of a text that is ASCII throughout, the plain lower case is the same, and cheaper.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # The matches of the terms' pattern are what its complement leaves between.
    return F.array_remove(F.split(low, BETWEEN), "")


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents of the group with the term)."""
    every = docs.select("lang", "source", terms(F.col("text")).alias("every"))
    said = F.struct(F.lit(0).alias("docs"), F.col("every").alias("terms"))
    held = F.struct(F.lit(1).alias("docs"), F.array_distinct("every").alias("terms"))
    rows = every.select("lang", "source", F.explode(F.array(said, held)).alias("p")).select("lang", "source", "p.docs", F.explode("p.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("docs")).alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term and count (in the whole language) of the terms in ``least_docs`` documents of their language."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    return kept.where(F.col("docs") >= least_docs).select("lang", "term", "count")


def group_sizes(counts: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source and n of every group, with n_lang of its language: occurrences of kept terms; and v, the number of these terms."""
    langs = kept.groupBy("lang").agg(F.sum("count").alias("n_lang"), F.count("*").alias("v"))
    own = counts.select("lang", "source", "term", "count").join(kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("count").alias("n"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "n_lang", "v")


def dense_shares(counts: DataFrame, sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, used (whether the group has it), p and q (the language's p) of every group and every kept term of its language."""
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("part")
    every = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).join(kept.select("lang", part, "term", F.col("count").alias("whole")), ["lang", "part"])
    own = every.join(counts.select("lang", "source", "term", "count"), ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))

    def share(count: str, n: str) -> Column:
        return F.expr(f"1 + cast({count} + 1 as decimal(20,0)) * cast({UNIT} as decimal(10,0)) div cast({n} + v as decimal(20,0))")

    return own.select("lang", "source", "term", (F.col("count") > 0).alias("used"), share("count", "n").alias("p"), share("whole", "n_lang").alias("q"))


#: (p - q)^2 / q, rounded down; at least 0.
GAP = "(p - q) * (p - q) div q"


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of every group."""
    empty = F.lit("")
    named = docs.select(F.coalesce(column(docs, text), empty).alias("text"), F.coalesce(column(docs, lang), empty).alias("lang"), F.coalesce(column(docs, source), empty).alias("source"))
    counts = checkpoint(group_counts(named))
    groups = checkpoint(named.select("lang", "source").distinct())
    kept = checkpoint(kept_terms(counts, least_docs))
    sizes = checkpoint(group_sizes(counts, groups, kept))
    shares = checkpoint(dense_shares(counts, sizes, kept))
    forget(counts)

    one, other = shares.alias("a"), shares.alias("b")
    met = one.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    # Each two groups meet once a term, for both directions.
    two = met.select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.p").alias("p"), F.col("b.p").alias("q"))
    two = two.groupBy("lang", "source", "item").agg(F.sum(F.expr(GAP)).alias("there"), F.sum(F.expr("(p - q) * (p - q) div p")).alias("back"))
    sides = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    sums = two.select("lang", F.explode(sides).alias("s")).select("lang", "s.source", "s.item", "s.value")
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    terms_ = shares.where("used and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(GAP).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms_, "term").where(F.col("rank") <= most_terms))
