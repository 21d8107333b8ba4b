"""Quality rules as a short-circuit cascade (operator 4).

Each rule looks at one text and rejects it or not. Before the run every rule's cost (seconds)
and selectivity (share of texts rejected) are estimated on a sample, the first rows of every
partition, so that no part of a sorted table is left out and nothing is read twice whole. What several
rules need (bytes, words) is measured apart and charged to the first of them. The rules then run in
the order of rejections per second, and a text that one rule rejects meets no later one.
The order changes the work done, never the verdict.

Defined results: a null or empty text has no words; texts of any length are measured whole;
the verdict is a function of the text alone, so repeated rows agree; an empty table gives an
empty result; other columns pass through and the new ones give way (``kept_``) where a column of that name exists.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, free_name
from quarry.llm.words import windows, word_hashes

# Fixed values.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"

#: Rows of each partition on which costs and selectivities are estimated.
SAMPLE_ROWS = 64


class Text:
    """One text and what rules measure of it, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> np.ndarray:
        return word_hashes(self.raw)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points inside words."""
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, BLANKS)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier line."""
        worded = [x for x in self.raw.split(b"\n") if x.strip(BLANKS)]
        return len(worded), len(worded) - len(set(worded))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that is found twice or more."""
        found = windows(self.words, 3)
        if not len(found):
            return 0
        order = np.sort(found)
        again = order[1:][order[1:] == order[:-1]]
        if not len(again):
            return 0
        twice = again[np.minimum(np.searchsorted(again, found), len(again) - 1)] == found
        covered = np.zeros(self.n_words, bool)
        for j in range(3):
            covered[j : j + len(twice)] |= twice
        return int(covered.sum())

    @cached_property
    def top_word(self) -> int:
        """Times that the most frequent word is found."""
        if not self.n_words:
            return 0
        order = np.sort(self.words)
        edges = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
        return int(np.diff(np.append(edges, self.n_words)).max())

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Letters that have cases, and capitals among them."""
        text = self.text
        if text.isascii():
            raw = np.frombuffer(self.raw, np.uint8)
            upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
            return upper + int(np.count_nonzero((raw >= 97) & (raw <= 122))), upper
        upper = sum(map(str.isupper, text))
        return upper + sum(map(str.islower, text)), upper


@dataclass(frozen=True)
class Rule:
    """A name, a test that is true for a text to be rejected, and what of the text it shares with other rules."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = ("raw", "words")


#: What every text must pass before the method's own rules count: enough words, not mostly repeated ones.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)

RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.lines[1] > 4 * t.lines[0], ("raw",)),
    Rule("capitals", lambda t: 2 * t.letters[1] > t.letters[0], ("raw",)),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
)

STATISTICS = {
    "n_words": lambda t: t.n_words,
    "word_chars": lambda t: t.word_chars,
    "n_symbols": lambda t: t.n_symbols,
    "n_dup_lines": lambda t: t.lines[1],
    "n_repeat_words": lambda t: t.n_repeat_words,
}


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds, 1e-9)


def measured(texts: list[str | None], rules: tuple[Rule, ...]) -> list[tuple[str, float, int, int]]:
    """Of each rule alone, and of each thing that rules need: name, seconds, rejections, texts."""
    spent = dict.fromkeys([*dict.fromkeys(x for r in rules for x in r.needs), *(r.name for r in rules)], 0.0)
    rejected = dict.fromkeys(spent, 0)
    needs = [x for x in spent if hasattr(Text, x)]
    for text in texts:
        shared = Text(text)
        for x in needs:
            began = time.perf_counter()
            getattr(shared, x)
            spent[x] += time.perf_counter() - began
        for rule in rules:
            own = Text(text)
            own.__dict__.update({x: getattr(shared, x) for x in needs})
            began = time.perf_counter()
            rejected[rule.name] += bool(rule.rejects(own))
            spent[rule.name] += time.perf_counter() - began
    return [(x, spent[x], rejected[x], len(texts)) for x in spent]


def in_order(rules: tuple[Rule, ...], seconds: dict[str, float], rejected: dict[str, float]) -> list[Estimate]:
    """The rules by rejections per second: each time the best one, given what those before it have made known."""
    left, known, out = [*rules], set(), []
    while left:
        costs = [Estimate(r, seconds.get(r.name, 0.0) + sum(seconds.get(x, 0.0) for x in r.needs if x not in known), rejected.get(r.name, 0.0)) for r in left]
        best = max(costs, key=lambda e: e.rank)
        out.append(best)
        left.remove(best.rule)
        known.update(best.rule.needs)
    return out


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules with their estimates, most rejections per second first. Only sums reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = sample_rows
        for batch in batches:
            part = batch["text"].iloc[:left].tolist()
            left -= len(part)
            if part:
                yield pd.DataFrame(measured(part, rules), columns=["rule", "s", "rejected", "n"])
            if left <= 0:
                return  # the rest of the partition is not read

    sums = docs.select(column(docs, text).alias("text")).mapInPandas(run, "rule string, s double, rejected long, n long").groupBy("rule")
    found = sums.agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    return in_order(rules, {r["rule"]: r["s"] / r["n"] for r in found}, {r["rule"]: r["rejected"] / r["n"] for r in found})


def apply_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES + RULES,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    statistics: bool = False,
) -> DataFrame:
    """``docs`` with kept and rejected_by (the first rule that rejects, null if kept).

    ``statistics``: also the numbers in STATISTICS, for every text. One pass without a shuffle.
    """
    ordered = tuple(e.rule for e in plan_cascade(docs, rules, text, sample_rows))
    measures = STATISTICS if statistics else {}
    schema = "rejected_by string" + "".join(f", {x} long" for x in measures)

    @F.pandas_udf(schema)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                t = Text(text)
                rows.append((next((r.name for r in ordered if r.rejects(t)), None), *(f(t) for f in measures.values())))
            yield pd.DataFrame(rows, columns=["rejected_by", *measures])

    own, kept = free_name(docs, "verdict"), free_name(docs, "kept")
    names = {x: free_name(docs, x) for x in ("rejected_by", *measures)}
    out = docs.select("*", verdict(column(docs, text)).alias(own))
    return out.select("*", *(F.col(own)[x].alias(y) for x, y in names.items())).drop(own).withColumn(kept, F.col(names["rejected_by"]).isNull())
