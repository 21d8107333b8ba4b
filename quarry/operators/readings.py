"""Romanised readings of words, and words in typed text: what typing in another script needs.

The reading table is the user's: ``text`` (a character or a phrase) and ``reading`` (its syllables, blank-separated, without
tones). A phrase tells which reading a character has there that has several.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Han characters, extension A and compatibility forms included.
HAN = r"[㐀-鿿豈-﫿]"
_HAN_RUN, _PIECE = regex.compile(HAN + "+"), regex.compile(HAN + r"+|(?:(?!" + HAN + r")[\p{L}\p{N}])+")
#: Characters of the longest word that typed text is searched for.
LONGEST_WORD = 16


def _syllables(reading: Column) -> Column:
    """ü is written v."""
    return F.filter(F.split(F.replace(F.lower(reading), F.lit("ü"), F.lit("v")), " "), lambda x: x != "")


def readings(words: DataFrame, table: DataFrame) -> DataFrame:
    """term, full and initials of the words (term) with a Han character.

    From left to right the longest text of the table that stands at a place is read, then what follows it. Characters that
    the table lacks, and those of other scripts, stay as they are. Of several readings of one text the alphabetically first counts.
    A word is found in the table by joining its substrings, so neither side has to fit anywhere whole.
    """
    own = words.select("term").where(F.col("term").rlike(HAN)).distinct().withColumn("low", F.lower("term"))
    known = table.select(F.lower("text").alias("piece"), _syllables(F.col("reading")).alias("said")).where("piece <> '' and size(said) > 0").groupBy("piece").agg(F.min("said").alias("said"))
    longest = known.agg(F.coalesce(F.max(F.char_length("piece")), F.lit(0))).first()[0]
    at = F.explode(F.sequence(F.lit(1), F.char_length("low"))).alias("at")
    spans = own.select("term", "low", at).where(F.substring("low", F.col("at"), F.lit(1)).rlike(HAN))
    most = F.least(F.lit(max(1, longest)), F.char_length("low") - F.col("at") + 1)
    spans = spans.select("term", "low", "at", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    # Spans that the table lacks stay, so that every word comes out and the words are made only once.
    found = spans.select("term", "at", "n", F.substring("low", F.col("at"), F.col("n")).alias("piece")).join(known, "piece", "left")
    best = found.groupBy("term", "at").agg(F.max(F.when(F.col("said").isNotNull(), F.struct("n", "said"))).alias("best"))
    piece = F.when(F.col("best").isNotNull(), F.struct("at", "best.n", "best.said"))
    read = best.groupBy("term").agg(F.collect_list(piece).alias("pieces")).withColumn("low", F.lower("term"))  # no more pieces than the word has characters

    def step(state: Column, i: Column) -> Column:
        here = F.filter(F.col("pieces"), lambda p: p["at"] == i)
        hit, char = F.try_element_at(here, F.lit(1)), F.substring(F.col("low"), i, F.lit(1))
        none = hit.isNull()
        after = F.struct(
            F.when(none, i + 1).otherwise(i + hit["n"]).alias("next"),
            F.concat(state["full"], F.when(none, char).otherwise(F.array_join(hit["said"], ""))).alias("full"),
            F.concat(state["initials"], F.when(none, char).otherwise(F.array_join(F.transform(hit["said"], lambda x: F.substring(x, 1, 1)), ""))).alias("initials"),
        )
        return F.when(i < state["next"], state).otherwise(after)

    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("full"), F.lit("").alias("initials"))
    return read.select("term", F.aggregate(F.sequence(F.lit(1), F.char_length("low")), start, step).alias("r")).select("term", "r.full", "r.initials")


def possible_words(text: str) -> set[str]:
    """What may be a word in a typed text: every stretch of its runs of Han characters."""
    low = text.strip().lower()
    return {run[i : i + n] for run in _HAN_RUN.findall(low) for i in range(len(run)) for n in range(1, min(LONGEST_WORD, len(run) - i) + 1)}


def segmented(text: str, counts: dict[str, int]) -> list[str]:
    """The words of a typed text. ``counts``: how many items hold each of its ``possible_words`` that is known.

    Runs of other letters and digits are words. A run of Han characters is cut where the product of its words' shares
    of all counts is largest; a character in no known word counts as seen once. Ties go to fewer words, then to longer first ones.
    """
    total = sum(counts.values()) + 1
    out: list[str] = []
    for piece in _PIECE.findall(text.strip().lower()):
        if not _HAN_RUN.fullmatch(piece):
            out.append(piece)
            continue
        # Best cut of what begins at each place: (cost, words, lengths of the words, negated).
        best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] * (len(piece) + 1)
        for i in reversed(range(len(piece))):
            ways = []
            for n in range(1, min(LONGEST_WORD, len(piece) - i) + 1):
                seen = counts.get(piece[i : i + n], 1 if n == 1 else 0)
                if seen:
                    cost, more, lengths = best[i + n]
                    ways.append((round(cost - math.log(seen / total), 9), more + 1, (-n, *lengths)))
            best[i] = min(ways)
        at = 0
        for n in best[0][2]:
            out.append(piece[at : at - n])
            at -= n
    return out
