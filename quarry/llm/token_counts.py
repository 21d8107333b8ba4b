"""Token counts by heap-and-linked-list byte-pair merging (operator 8).

A text is cut into pre-tokens; each pre-token starts as one symbol per byte, and a heap
holds every adjacent pair that has a merge rank. The lowest rank (the leftmost on ties) is
popped, its two list nodes become one, and the pairs with the new neighbours enter the
heap. The count is the number of initial symbols minus the number of merges; no
identifier of a token is ever produced.

Defined results: a null or empty text has 0 tokens; a text of any length is counted whole,
in bounded pieces that are cut where the pre-tokeniser always cuts; a special token's
string inside a text counts as the one token the library makes of it; repeated rows are
counted each; all other columns pass through unchanged and the new ones give way
(``name_``) where a column of that name exists.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, free_name, text_bytes

#: Entries that a worker's tables of known pieces hold before they start afresh.
MAX_CACHED = 400_000
#: Pieces of over so many characters are never kept.
MAX_CACHED_CHARS = 48
#: Characters that are cut into pieces at once.
SLICE_CHARS = 1_000_000

# White space beside the blank and the line feed, as the pre-tokeniser's \s has it
# (with the four separators that only Python counts as white space, which makes cuts rarer, never wrong).
OTHER_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others take 256, 257, ... in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def merged_length(symbols: list[int], ranks: list[dict[int, int]], merged: list[int]) -> int:
    """Symbols left after all merges.

    ``ranks``: for each left symbol, right symbol to rank; ``merged``: rank to symbol. The heap
    holds rank and position in one number; an entry counts only while ``pair`` has that rank there.
    """
    n = len(symbols)
    bits = n.bit_length()
    pair = [ranks[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push, mask = heapq.heappop, heapq.heappush, (1 << bits) - 1
    pair.append(-1)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    left = n
    while heap:
        top = pop(heap)
        i = top & mask
        if pair[i] != top >> bits:
            continue  # one of the two has been merged since
        s = symbols[i] = merged[top >> bits]
        j = after[i]
        pair[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            r = pair[i] = ranks[s].get(symbols[k], -1)
            if r >= 0:
                push(heap, r << bits | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            r = pair[h] = ranks[symbols[h]].get(s, -1)
            if r >= 0:
                push(heap, r << bits | h)
    return left


class Counter:
    """Counts the tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        import re

        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = {s: i for i, s in enumerate(byte_symbols())}
        pairs, self.merged = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append((symbol[a], symbol[b]))
            self.merged.append(symbol.setdefault(a + b, len(symbol)))
        self.ranks: list[dict[int, int]] = [{} for _ in symbol]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[a].setdefault(b, rank)
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.findall = regex.compile(PATTERN).findall
        self.other_space = re.compile(OTHER_SPACE).search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def pre_token(self, s: str) -> int:
        found = self.words.get(s)
        if found is None:
            found = merged_length([*s.encode("utf-8")], self.ranks, self.merged)
            if len(s) <= MAX_CACHED_CHARS:
                if len(self.words) >= MAX_CACHED:
                    self.words.clear()
                self.words[s] = found
        return found

    def whole(self, s: str) -> int:
        """Tokens of a string that no cut has made."""
        parts = self.special.split(s) if any(x in s for x in self.specials) else [s]
        return len(parts) - 1 + sum(self.pre_token(x) for part in parts for x in self.findall(part))

    def piece(self, s: str) -> int:
        """Tokens of a blank and then ``s``."""
        found = self.pieces.get(s)
        if found is None:
            found = self.whole(" " + s)
            if len(s) <= MAX_CACHED_CHARS:
                if len(self.pieces) >= MAX_CACHED:
                    self.pieces.clear()
                self.pieces[s] = found
        return found

    def slices(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether a blank (dropped) stood before it."""
        at, blank = 0, False
        while len(text) - at > SLICE_CHARS:
            end = at + SLICE_CHARS
            while 0 <= (end := text.find(" ", end)) < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
                end += 1
            if not 0 <= end < len(text) - 1:
                break
            yield text[at:end], blank
            at, blank = end + 1, True
        yield text[at:] if at else text, blank

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for part, blank in self.slices(text):
            # A single blank between two other characters always begins a pre-token.
            if "  " in part or " \n" in part or "\n " in part or self.other_space(part) or part[0] == " " or part[-1] == " ":
                pieces = self.cut(part)
            else:
                pieces = part.split(" ")
            if blank:
                total += self.piece(pieces[0])
            else:
                total += self.whole(pieces[0])
            known, rest = self.pieces, self.piece
            for s in pieces[1:]:
                n = known.get(s)
                total += rest(s) if n is None else n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker process and vocabulary."""
    return Counter(path)


def vocabulary(name_or_path: str) -> str:
    """The file of a public tokenizer's name, or the path itself."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def count_tokens(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    One pass without a shuffle. A worker keeps two bounded tables of known pieces.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary(vocabulary_file))
        for batch in batches:
            yield pd.Series([own.count(x) for x in batch], dtype="int64")

    body = column(docs, text)
    n_bytes, n_tokens, over = (free_name(docs, x) for x in ("n_bytes", "n_tokens", "over_limit"))
    out = docs.select("*", text_bytes(body).alias(n_bytes), tokens(body).alias(n_tokens))
    return out.withColumn(over, F.col(n_tokens) > limit)
