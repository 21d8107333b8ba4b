"""Harmonic packing of token sequences (operator 7).

Lengths fall into reciprocal-capacity classes: class j holds lengths in (C/(j+1), C/j], and a
bin of class j takes exactly j pieces. Documents may be cut, so each is cut into pieces that
(nearly) fill their class: whole capacities first, then, while j pieces of the rest would
leave more than ``slack`` of a bin unused, a piece of the next class's full length. Each
partition fills its own bins as its documents stream by and holds at most one open bin a
class (under 2 * sqrt(C) classes); at its end the open bins are joined first-fit by falling
size. No shuffle and no state across workers; a repeated task gives the same bins.

A document's tokens are those of the tokenizer file followed by one separator id. Texts are
encoded in pieces cut where the pre-tokeniser always cuts, and pieces met before come from
a bounded table, so that the library encodes each only once.

Defined results: a null or empty text is the separator alone; a text of any length is packed
whole; repeated rows are packed each; an empty table gives no piece; the id column keeps its
name and type, other columns are not carried.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import column
from quarry.llm.token_counts import OTHER_SPACE, vocabulary

CAPACITY = 1024
SLACK = 1 / 64
SEPARATOR = 0
#: Entries of a worker's table of known pieces, code points of a kept piece, texts and code points of a block.
MAX_CACHED = 1_000_000
MAX_CACHED_CHARS = 48
BLOCK_TEXTS, BLOCK_CHARS = 64, 1_000_000
#: Marks that are split off a piece before it is looked up.
MARKS = ".,"
#: Bytes of ids that a batch given back to the engine holds.
BATCH_BYTES = 4 << 20


class Encoder:
    """Texts to the library's ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # a piece to its ids, those of a blank and it unless it begins with a line feed
        self.marks = dict(zip(MARKS, self.ids([*MARKS]), strict=True))
        self.other_space = re.compile(OTHER_SPACE).search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split

    def pieces(self, text: str) -> list[str]:
        """The text cut where a pre-token always begins: at single blanks (dropped) and before single
        line feeds (kept), each between two other characters."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or self.other_space(text):
            return self.cut(text)
        return text.replace("\n", " \n").split(" ")

    def learn(self, new: Iterable[str]) -> list[str]:
        """Makes pieces known, and returns them with those that were made on the way.

        A mark after a letter or digit is a pre-token of its own, so the rest is looked up first.
        """
        known = self.known
        marked = [s for s in new if s[-1:] in MARKS and s[-2:-1].isalnum()]
        plain = {s[:-1] for s in marked}.difference(known)
        plain.update(set(new).difference(marked))
        fresh = [*plain]
        known.update(zip(fresh, self.ids([s if s[:1] == "\n" and s[1:2] not in ("", "\n") else " " + s for s in fresh]), strict=True))
        for s in marked:
            known[s] = known[s[:-1]] + self.marks[s[-1]]
        return fresh + marked

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        known = self.known
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < BLOCK_TEXTS and chars < BLOCK_CHARS:
                chars += len(texts[end])
                end += 1
            block = [self.pieces(x) for x in texts[at:end]]
            firsts = self.ids([x.pop(0) for x in block])
            new: set[str] = set()
            for x in block:
                new.update(x)
            fresh = self.learn(new.difference(known))  # looks up the few new ones, not all that are known
            out += [b"".join((first, *map(known.__getitem__, x))) for first, x in zip(firsts, block, strict=True)]
            for s in fresh:
                if len(s) > MAX_CACHED_CHARS:
                    del known[s]
            if len(known) > MAX_CACHED:  # what was met first is what is met most
                for s in [*islice(known, MAX_CACHED // 2, None)]:
                    del known[s]
            at = end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        fit = capacity // rest
        if capacity - fit * rest <= slack * capacity or fit == capacity:
            out.append(rest)
            break
        out.append(capacity // (fit + 1))
        rest -= out[-1]
    return out


class Packer:
    """Open bins of one partition; ``add`` and ``finish`` give bins, each a list of (length, piece)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, length: int, piece) -> list | None:
        fit = self.capacity // length
        held = self.open.setdefault(fit, [])
        held.append((length, piece))
        if len(held) == fit:
            return self.open.pop(fit)
        return None

    def finish(self) -> list[list]:
        """The bins left open, joined first-fit by falling size."""
        joined: list[list] = []
        room: list[int] = []
        sized = sorted(((sum(x[0] for x in held), fit, held) for fit, held in self.open.items()), key=lambda x: (-x[0], x[1]))
        for size, _, held in sized:
            for i, r in enumerate(room):
                if size <= r:
                    joined[i] += held
                    room[i] -= size
                    break
            else:
                joined.append([*held])
                room.append(self.capacity - size)
        self.open = {}
        return joined


def pack(
    docs: DataFrame,
    tokenizer_file: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY,
    slack: float = SLACK,
    separator: int = SEPARATOR,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row a piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``sequence_id`` holds the partition in its upper bits; offsets are gapless from 0 in a sequence.
    """
    kind = docs.schema[key].dataType
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, t) for n, t in fields])
    tail = np.asarray([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(vocabulary(tokenizer_file)), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 40
        rows, held = [], 0
        names, key_type = [key, *(n for n, _ in fields)], None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def write(filled: list) -> None:
            nonlocal sequence, held
            at = 0
            for length, (doc, start, ids, total) in filled:
                rows.append((doc, start, length, ids, total, sequence, at))
                at += length
                held += len(ids)
            sequence += 1

        for got in batches:
            key_type = got.schema.field(0).type
            for at in range(0, got.num_rows, BLOCK_TEXTS):
                part = got.slice(at, BLOCK_TEXTS)
                for doc, ids in zip(part.column(0).to_pylist(), own.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    for length in cuts(total, capacity, slack):
                        filled = packer.add(length, (doc, start, ids[4 * start : 4 * (start + length)], total))
                        start += length
                        if filled:
                            write(filled)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        for filled in packer.finish():
            write(filled)
        if rows:
            yield batch()

    return docs.select(column(docs, key).alias(key), F.coalesce(column(docs, text), F.lit("")).alias("text")).mapInArrow(run, schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, padding: int = SEPARATOR) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids (binary, padded to ``capacity``)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    whole = packed.groupBy("sequence_id").agg(F.array_join(parts, "").alias("digits"))
    pad = F.lit(int(padding).to_bytes(4, "little").hex().upper())
    size = (F.length("digits") / 8).cast("int")
    return whole.select("sequence_id", size.alias("n_tokens"), F.unhex(F.concat("digits", F.repeat(pad, F.lit(capacity) - size))).alias("ids"))
