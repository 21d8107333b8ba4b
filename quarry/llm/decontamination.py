"""Benchmark decontamination by spaced-seed hashing (operator 1).

Texts become token hashes (lower-cased, ASCII punctuation as blanks). Fixed masks are laid on
every run of tokens; only the positions marked 1 are hashed, so a substituted token under
a 0 does not matter, and with several masks few substitutions can break them all. Hashes of
the benchmark and of the corpus are joined on equality. Around each hit, document and item
are compared along the hit's diagonal, and the segment with the best score (a match +1, a
difference -2) is the overlap. It counts if enough tokens match, at least three in four of
the segment.

The corpus is read once. Benchmark hashes first set bits of a bitmap of fixed size, and only
positions whose bit is set go on, with the tokens around them, to the join; a larger
benchmark fills the bitmap and makes the join larger, never wrong.

Defined results: null and empty texts have no tokens and no overlap; very long texts are read
whole, and only the tokens around hits leave the worker; items of fewer than
``MIN_ITEM`` tokens cannot be told from chance inside a sentence and are searched for only with
``short``, as whole texts of equal tokens or, from ``LEAST_LINE`` tokens on, whole lines ("Yes." on a line of its own
tells nothing); items with equal
tokens are searched for once, under their smallest id; a document has one row an item, its
longest overlap (the earliest on ties); rows with a null id are compared under the null id;
rows that share an id count as one document; empty tables give an empty result; ids may be of
any type that can be joined on; only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpoint, column, free_name, spread_join
from quarry.llm.words import mixed, numbers, word_hashes

# Six hashed tokens each, over seven to ten; the last mask is for short items alone.
MASKS = ("1110111", "11011011", "110101011", "1100110011", "1111")
SPAN = max(map(len, MASKS))
MIN_ITEM = 8
#: Tokens of a line that can be an item as a whole; shorter ones only where the whole text has no more.
LEAST_LINE = 4
#: Items of fewer tokens have the last mask's hashes too: a substitution leaves them few windows.
SHORT_ITEM = 16
#: Matching tokens that an overlap needs; of shorter items four in five.
MIN_MATCHES = 12
MISMATCH = -2
#: Tokens kept on either side of a hit.
MARGIN = 64
#: Bits of the bitmap (its size is fixed: 8 MB), and of the small one that is asked first.
BITS, FIRST_BITS = 26, 20

_TIMES = numbers(51, 64) | np.uint64(1)
_SALT = numbers(52, 64)
_PUNCTUATION = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def tokens(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8").translate(_PUNCTUATION))


def seeds(found: np.ndarray, mask: int) -> np.ndarray:
    """The hash under a mask (by number) at each position where it fits."""
    shape = MASKS[mask]
    n = len(found) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _SALT[mask], np.uint64)
    for j, x in enumerate(shape):
        if x == "1":
            total += found[j : j + n] * _TIMES[j]
    return mixed(total)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start in ``doc``, length and matches of the best segment along doc index = item index + diagonal."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return 0, 0, 0
    same = doc[a + diagonal : b + diagonal] == item[a:b]
    run = np.concatenate(([0], np.cumsum(np.where(same, 1, MISMATCH))))
    low = np.minimum.accumulate(run)
    end = int(np.argmax(run - low))
    start = int(np.argmax(run[: end + 1] == low[end]))
    return a + diagonal + start, end - start, int(same[start:end].sum())


def enough(matches: int, length: int, item: int, min_matches: int = MIN_MATCHES) -> bool:
    return length > 0 and matches >= min(min_matches, -(-4 * item // 5)) and 4 * matches >= 3 * length


_LONGS = T.ArrayType(T.LongType())


def _schema(rows: DataFrame, key: str, **fields: T.DataType) -> T.StructType:
    """The key as ``rows`` have it, and further fields."""
    return T.StructType([rows.schema[key], *(T.StructField(n, t) for n, t in fields.items())])


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """item_id and tokens of each different item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(x.as_py()).view(np.int64) for x in batch.column(1)]
            long = [len(x) > 0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(long)), pa.array([x for x, y in zip(found, long, strict=True) if y], pa.list_(pa.int64()))], ["item_id", "tokens"])

    rows = benchmark.select(column(benchmark, key).alias("item_id"), column(benchmark, text).alias("text"))
    return rows.mapInArrow(run, _schema(rows, "item_id", tokens=_LONGS)).groupBy("tokens").agg(F.min("item_id").alias("item_id"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """seed, item_id and at: every hash of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = len(MASKS) if len(found) < SHORT_ITEM else len(MASKS) - 1
                own = [seeds(np.asarray(found.values).view(np.uint64), m) for m in range(n)]
                at = np.concatenate([np.arange(len(x)) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array([i] * len(at), batch.schema.field(0).type), pa.array(at, pa.int32())], ["seed", "item_id", "at"])

    schema = T.StructType([T.StructField("seed", T.LongType()), items.schema["item_id"], T.StructField("at", T.IntegerType())])
    return items.select("item_id", "tokens").mapInArrow(run, schema)


def _bitmap(item_seeds: DataFrame) -> np.ndarray:
    """The bitmap of all seeds, as bytes. At most 2 ** (BITS - 6) numbers reach the driver."""
    spot = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1))
    words = item_seeds.select(F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, cast((seed & {(1 << BITS) - 1}L) & 63L as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint8)


def _regions(docs: DataFrame, bitmap: np.ndarray, key: str, text: str) -> DataFrame:
    """Stretches of documents around positions whose seed is in the bitmap: doc_id, start, tokens, and the seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.uint8)
        spots = np.flatnonzero(np.unpackbits(own, bitorder="little"))
        first = np.zeros(1 << FIRST_BITS, bool)
        first[spots & ((1 << FIRST_BITS) - 1)] = True
        low, few = np.uint64((1 << BITS) - 1), np.uint64((1 << FIRST_BITS) - 1)
        for batch in batches:
            out = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(x.as_py())
                at, hashes = [], []
                for m in range(len(MASKS)):
                    s = seeds(found, m)
                    hit = np.flatnonzero(first[(s & few).astype(np.int64)])
                    spot = (s[hit] & low).astype(np.int64)
                    hit = hit[(own[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
                    at.append(hit)
                    hashes.append(s[hit])
                spot, seed = np.concatenate(at), np.concatenate(hashes)
                if not len(spot):
                    continue
                order = np.argsort(spot, kind="stable")
                spot, seed = spot[order], seed[order]
                for part in np.split(np.arange(len(spot)), np.flatnonzero(np.diff(spot) > MARGIN) + 1):
                    a = max(0, int(spot[part[0]]) - MARGIN)
                    b = int(spot[part[-1]]) + SPAN + MARGIN
                    out.append((doc, a, found[a:b].view(np.int64), spot[part].astype(np.int32), seed[part].view(np.int64)))
            if out:
                cols = zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["doc_id", "start", "tokens", "spots", "seeds"])

    rows = docs.select(column(docs, key).alias("doc_id"), column(docs, text).alias("text"))
    return rows.mapInArrow(run, _schema(rows, "doc_id", start=T.LongType(), tokens=_LONGS, spots=T.ArrayType(T.IntegerType()), seeds=_LONGS))


def _whole_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, start and tokens of each line of ``LEAST_LINE`` tokens or more, and of each whole text, of fewer than ``MIN_ITEM``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = [tokens(line) for line in (x.as_py() or "").split("\n")]
                starts = np.cumsum([0, *map(len, lines)])
                out += [(doc, int(a), line.view(np.int64)) for a, line in zip(starts, lines) if LEAST_LINE <= len(line) < MIN_ITEM]
                if 0 < starts[-1] < MIN_ITEM:
                    out.append((doc, 0, np.concatenate(lines).view(np.int64)))
            if out:
                cols = zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["doc_id", "start", "tokens"])

    rows = docs.select(column(docs, key).alias("doc_id"), column(docs, text).alias("text"))
    return rows.mapInArrow(run, _schema(rows, "doc_id", start=T.LongType(), tokens=_LONGS))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_matches: int = MIN_MATCHES,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    short: bool = False,
) -> DataFrame:
    """doc_id, item_id, start and length (tokens of the document), matches and item_tokens of every overlap.

    ``short``: also items of fewer than ``MIN_ITEM`` tokens, where a whole text or line equals them.
    """
    every = checkpoint(_items(benchmark, item_key, item_text))
    items = every.where(F.size("tokens") >= MIN_ITEM)
    item_seeds = checkpoint(_item_seeds(items))
    regions = checkpoint(_regions(docs, _bitmap(item_seeds), key, text).withColumn("region", F.xxhash64("doc_id", "start", "tokens")))
    hits = regions.select("region", F.explode(F.arrays_zip("spots", "seeds")).alias("hit")).select("region", F.col("hit.spots").alias("spot"), F.col("hit.seeds").alias("seed"))
    # A passage that very many documents hold is one key of the first join, an item that very many hold one of the second.
    met = spread_join(hits, item_seeds, "seed", "region", hits.groupBy("seed").agg(F.count("*").alias("n")))
    lines = checkpoint(met.select("region", "item_id", (F.col("spot") - F.col("at")).alias("diagonal")).distinct())
    whole = spread_join(lines, items, "item_id", "region", lines.groupBy("item_id").agg(F.count("*").alias("n")))
    whole = whole.join(regions.select("region", "doc_id", "start", F.col("tokens").alias("around")).dropDuplicates(["region"]), "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, start, diagonal, around, item, theirs in zip(*(batch.column(i) for i in range(6)), strict=True):
                a, b = (np.asarray(x.values) for x in (around, theirs))
                first, length, matches = overlap(a, b, diagonal.as_py() - start.as_py())
                if enough(matches, length, len(b), min_matches):
                    out.append((doc.as_py(), item.as_py(), first + start.as_py(), length, matches, len(b)))
            if out:
                kinds = [batch.schema.field(0).type, batch.schema.field(4).type, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "length", "matches", "item_tokens"])

    schema = T.StructType([whole.schema["doc_id"], whole.schema["item_id"], *(T.StructField(x, T.LongType()) for x in ("start", "length", "matches", "item_tokens"))])
    found = whole.select("doc_id", "start", "diagonal", "around", "item_id", "tokens").mapInArrow(run, schema)
    best = F.max_by(F.struct("start", "length", "matches", "item_tokens"), F.struct("matches", -F.col("length"), -F.col("start")))
    few = every.where(F.size("tokens") < MIN_ITEM)
    if short and not few.isEmpty():
        n = F.size("tokens").cast("long")
        # A line that very many documents have is one key.
        own = checkpoint(_whole_lines(docs, key, text))
        equal = spread_join(own, few, "tokens", "doc_id", own.groupBy("tokens").agg(F.count("*").alias("n")))
        found = found.unionByName(equal.select("doc_id", "item_id", "start", n.alias("length"), n.alias("matches"), n.alias("item_tokens")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, key: str = "doc_id", text: str = "text", short: bool = False, by_row: bool = False) -> DataFrame:
    """``docs`` without the documents that overlap the benchmark.

    Rows with a null id are kept, or with ``by_row`` judged each by its own text: a hash of it stands for their id.
    """
    if by_row:
        row, own = free_name(docs, "row"), column(docs, key).cast("string")
        keyed = docs.withColumn(row, F.coalesce(own, F.concat(F.lit("null id "), F.xxhash64(column(docs, text)).cast("string"))))
        kept = decontaminate(keyed, benchmark, min_matches, row, text, short)
        return kept.select(*(column(kept, c) for c in docs.columns))
    leaks = overlaps(docs, benchmark, min_matches, key, text, short=short).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaks, key, "left_anti")
