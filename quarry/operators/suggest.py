"""Weighted typeahead over a ranked word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the kinds of match, on the term itself and on its romanised reading.
EXACT, PREFIX, CONTAINS, FUZZY = 100, 60, 30, 8
READ_EXACT, READ_INITIALS, READ_PREFIX, READ_CONTAINS = 90, 60, 45, 22
#: Only so many of the highest-ranked words are compared by edit distance; tokens of fewer characters are not looked for in readings.
FUZZY_RANKS, MIN_READ = 3000, 2
MOST = 12


def is_fuzzy(term: Column, token: Column) -> Column:
    """At most one edit apart, or two if the token has four characters or more."""
    most = F.when(F.char_length(token) >= 4, 2).otherwise(1)
    near = F.abs(F.char_length(term) - F.char_length(token)) <= 2
    return near & F.levenshtein(term, token, 2).between(0, most)


def token_score(term: Column, token: Column, fuzzy: Column) -> Column:
    return (
        F.when(term == token, EXACT)
        .when(term.startswith(token), PREFIX)
        .when(term.contains(token), CONTAINS)
        .when(fuzzy & is_fuzzy(term, token), FUZZY)
        .otherwise(0)
    )


def reading_score(full: Column, initials: Column, token: Column) -> Column:
    """``v`` in a reading also answers to ``u``."""
    return (
        F.when(full == token, READ_EXACT)
        .when(full.startswith(token), READ_PREFIX)
        .when(full.contains("v") & F.replace(full, F.lit("v"), F.lit("u")).startswith(token), READ_PREFIX)
        .when(initials.startswith(token), READ_INITIALS)
        .when(full.contains(token), READ_CONTAINS)
        .otherwise(0)
    )


def suggestion_scores(words: DataFrame, tokens: list[str], readings: DataFrame | None = None) -> DataFrame:
    """term, rank and score of the words (term, rank from 0) that match: each token's weight times its length, added up.

    ``readings``: term, full and initials of words with a romanised reading; their score is added.
    The few typed tokens are literals, so one pass over the words does.
    """
    low = F.lower("term")
    own = sum((token_score(low, F.lit(t), F.col("rank") < FUZZY_RANKS) * len(t) for t in tokens), F.lit(0))
    scored = words.select("term", "rank", own.cast("long").alias("score"))
    if readings is not None:
        read = sum((reading_score(F.col("full"), F.col("initials"), F.lit(t)) * len(t) for t in tokens if len(t) >= MIN_READ), F.lit(0))
        more = readings.select("term", read.cast("long").alias("read"))
        scored = scored.join(more, "term", "left").select("term", "rank", (F.col("score") + F.coalesce("read", F.lit(0))).alias("score"))
    return scored.where("score > 0").groupBy("term").agg(F.min("rank").alias("rank"), F.sum("score").alias("score"))


def suggestions(words: DataFrame, tokens: list[str], most: int = MOST, readings: DataFrame | None = None) -> DataFrame:
    """The best matches, ties by rank."""
    return suggestion_scores(words, tokens, readings).orderBy(F.desc("score"), "rank", "term").limit(most)


#: Characters of the n-grams by which words that contain a token are found.
GRAM = 3


def grams(words: DataFrame) -> DataFrame:
    """gram, rank and term: one row for each distinct run of one to ``GRAM`` characters in each word (term, rank)."""
    low = F.lower("term")

    def runs(n: int) -> Column:  # the lambda has one parameter: a second one would be the place in the list
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))

    each = F.explode(F.array_distinct(F.concat(*map(runs, range(1, GRAM + 1)))))
    return words.select(each.alias("gram"), "rank", "term")


def gram_candidates(words: DataFrame, by_gram: DataFrame, tokens: list[str], first: int) -> DataFrame:
    """The words (term, rank) that can match any token, each once: the ``first`` ranks whole, for edits, and of the others those that hold a token.

    A word that holds a token holds the token's first ``GRAM`` characters, which are looked up.
    """
    holds = F.lit(False)
    for t in tokens:
        holds = holds | ((F.col("gram") == t[:GRAM]) & F.lower("term").contains(t))
    looked = by_gram.where(F.col("gram").isin(*{t[:GRAM] for t in tokens}) & (F.col("rank") >= first) & holds)
    return words.where(F.col("rank") < first).select("term", "rank").unionByName(looked.select("term", "rank").distinct())
