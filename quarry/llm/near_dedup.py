"""MinHash near-deduplication with odd sketches (operator 3).

1. Every text becomes its set of word shingles (64-bit hashes); equal sets are one class,
   kept once, whatever the number of copies.
2. A class has ``rows * bands`` MinHash samples. Each band of ``rows`` samples is a bucket
   key; the number of bands follows from the threshold, so that a pair at the threshold
   shares no bucket with a probability below ``MISS``.
3. All samples are folded into an odd sketch, a bitmap in which each sample toggles one
   bit. The population count of two sketches' XOR estimates their similarity closely where it
   is high. Inside a bucket, classes are joined if this estimate is not clearly (``MARGIN``)
   below the threshold.
4. Classes so connected meet in one task with their whole sets, and links are confirmed
   exactly. A connected group of over ``BLOCK_SHINGLES`` shingles is dealt in blocks and every pair
   of blocks is a task, so memory stays bounded and no link is lost.
5. Components of the confirmed links, labelled by their smallest id.

Nothing is capped: a bucket of over ``MAX_BUCKET`` classes is passed on unfiltered as a star
around its smallest id, which only makes the exact step's groups larger. Pairs are never
listed; each task gives at most one edge a member. Rows of one key that may be very many (copies of
one text, a bucket, a hub of the graph) are dealt over many tasks.

Defined results: a null or empty text, or one without words, has an empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle; a very long text is taken in
slices, and only its set is held whole; rows with a null id are
linked with nothing and kept; rows that share an id (ids are meant to be unique) are one node and
get a row each; an empty table gives an empty result; only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_key, checkpoint, column, forget, spread_join
from quarry.llm.components import components
from quarry.llm.words import mixed, numbers, shingles, word_hashes

ROWS = 6
#: Probability that a pair at the threshold shares no band.
MISS = 1e-8
SKETCH_BITS = 512
#: Estimates so far below the threshold still count as candidates: about six standard deviations.
MARGIN = 0.18
MAX_BUCKET = 20_000
BLOCK_SHINGLES = 1_000_000

_MIN_XOR = numbers(41, 1024)
_MIN_TIMES = numbers(42, 1024) | np.uint64(1)
_BAND_TIMES = numbers(43, 64) | np.uint64(1)
_CHUNK = 256


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def text_shingles(text: str | None, k: int) -> np.ndarray:
    """The set of a text: sorted hashes of its ``k``-word shingles, A-Z lower-cased."""
    return shingles(word_hashes((text or "").encode("utf-8").lower()), k)


def samples(found: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash samples of a set of hashes that is not empty."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    flip, times = _MIN_XOR[:n], _MIN_TIMES[:n]
    for at in range(0, len(found), _CHUNK):
        np.minimum(least, ((found[at : at + _CHUNK, None] ^ flip) * times).min(0), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` samples."""
    bands = least.reshape(-1, rows)
    return mixed((bands * _BAND_TIMES[:rows]).sum(1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64))


def odd_sketch(least: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity bitmap of the samples: each (number, value) toggles one bit."""
    spots = mixed(least + np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def most_differing_bits(similarity: float, n: int, bits: int = SKETCH_BITS) -> int:
    """The population count that the XOR of two sketches of ``n`` samples has at this similarity."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * n * (1 - similarity) / bits)))


def estimate(differing: int, n: int, bits: int = SKETCH_BITS) -> float:
    """The similarity at which that many bits differ."""
    left = 1 - 2 * differing / bits
    return 1 + bits / (4 * n) * math.log(left) if left > 0 else -math.inf


def clusters(sketches: np.ndarray, most: int) -> np.ndarray:
    """For each sketch (rows of 64-bit words) the first one that it reaches over pairs with at most so many differing bits."""
    n = len(sketches)
    first, rest = np.arange(n), np.arange(n)
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(sketches[rest] ^ sketches[queue.pop()]).sum(1) <= most
            if near.any():
                first[rest[near]] = root
                queue += rest[near].tolist()
                rest = rest[~near]
    return first


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that follow each other with the same first column, batches joined."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Edges:
    """Pairs of ids, given back in batches."""

    def __init__(self):
        self.u: list = []
        self.v: list = []

    def star(self, ids: np.ndarray, roots: np.ndarray) -> None:
        far = ids != roots
        self.u += ids[far].tolist()
        self.v += roots[far].tolist()

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.u) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(self.u, pa.int64()), pa.array(self.v, pa.int64())], ["u", "v"])
            self.u, self.v = [], []


def features(docs: DataFrame, k: int, n: int, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, set_hash (of the whole set, null if empty), band keys and odd sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for x in part.column(1).to_pylist():
                    found = text_shingles(x, k)
                    if not len(found):
                        out.append((0, None, None, None))
                        continue
                    least = samples(found, n)
                    both = (int(mixed(found).sum(dtype=np.uint64)), int(mixed(found ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)))
                    out.append((len(found), f"{both[0]:016x}{both[1]:016x}", band_keys(least, rows).view(np.int64), odd_sketch(least)))
                sizes, whole, bands, sketches = zip(*out, strict=True)
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "set_hash", "bands", "sketch"])

    rows_in = docs.select(column(docs, key).cast("long").alias("id"), column(docs, text).alias("text"))
    return rows_in.mapInArrow(run, "id long, n_shingles long, set_hash string, bands array<long>, sketch binary")


def _candidate_edges(classes: DataFrame, most: int) -> DataFrame:
    """(u, v): inside each band bucket, stars of the classes that odd sketches connect.

    A bucket too large for one task becomes a star around its smallest id by a join, which
    may be split over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges()
        for bucket in _runs(batches):
            ids = bucket.column(1).to_numpy()
            sketches = np.frombuffer(b"".join(bucket.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
            edges.star(ids, ids[clusters(sketches, most)])
            yield from edges.batch(20_000)
        yield from edges.batch()

    members = classes.select("id", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    shared = checkpoint(spread_join(members, shared, "band", "id", shared))
    stars = shared.where(F.col("n") > MAX_BUCKET).select(F.col("id").alias("u"), F.col("least").alias("v"))
    small = shared.where(F.col("n") <= MAX_BUCKET).join(classes.select("id", "sketch"), "id").select("band", "id", "sketch")
    small = small.repartition("band").sortWithinPartitions("band", "id")
    return small.mapInArrow(run, "u long, v long").unionByName(stars).distinct()


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the first one that it reaches over pairs with 100 * intersection >= threshold * 100 * union."""
    percent = round(threshold * 100)
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    first, rest = np.arange(n), np.arange(n)
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            own = flat[ends[i] - sizes[i] : ends[i]]
            able = (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)
            near = np.zeros(len(rest), bool)
            if able.any() and sizes[i]:
                marks[own] = True
                them = rest[able]
                spans = sizes[them]
                starts = np.cumsum(spans) - spans
                spots = np.arange(int(spans.sum())) + np.repeat(ends[them] - spans - starts, spans)
                common = np.add.reduceat(marks[flat[spots]].astype(np.int64), starts)
                marks[own] = False
                near[able] = 100 * common >= percent * (spans + sizes[i] - common)
            if near.any():
                first[rest[near]] = root
                queue += rest[near].tolist()
                rest = rest[~near]
    return first


def _confirmed_edges(docs: DataFrame, groups: DataFrame, classes: DataFrame, k: int, threshold: float, key: str, text: str) -> DataFrame:
    """(u, v): stars of the ids that exact similarities connect, from each group's whole texts.

    ``groups``: (id, component) of the ids that candidates connect; ``classes``: their n_shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Edges()
        for group in _runs(batches):
            ids = group.column(1).to_numpy()
            found = [text_shingles(x.as_py(), k) for x in group.column(2)]
            edges.star(ids, ids[linked(found, threshold)])
            yield from edges.batch(20_000)
        yield from edges.batch()

    sized = groups.join(classes.select("id", "n_shingles"), "id")
    sizes = sized.groupBy("component").agg(F.sum("n_shingles").alias("size"), F.count("*").alias("n"))
    large = sizes.where(F.col("size") > BLOCK_SHINGLES)
    large = large.select("component", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = spread_join(groups, large, "component", "id", sizes, "left").select("component", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    task = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))
    texts = docs.select(column(docs, key).cast("long").alias("id"), column(docs, text).alias("text"))
    dealt = texts.join(dealt.select("id", task.alias("task")), "id").select("task", "id", "text")
    dealt = by_key(dealt, "task").sortWithinPartitions("task", "id")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: the id, n_shingles, component_id (the smallest id reachable) and kept (it is that id)."""
    bands = band_count(threshold, rows)
    n = bands * rows
    every = checkpoint(features(docs, k, n, rows, key, text))
    worded = every.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull())
    copies = worded.groupBy("set_hash").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    dealt = checkpoint(spread_join(every, copies.select("set_hash", "least"), "set_hash", "id", copies, "left"))
    forget(every)
    named = dealt.select("id", "n_shingles", F.coalesce("least", "id").alias("class"))
    classes = dealt.where("set_hash is not null and id is not null and (least is null or least = id)").select("id", "n_shingles", "bands", "sketch")

    most = most_differing_bits(threshold - MARGIN, n)
    groups = components(_candidate_edges(classes, most))
    found = components(_confirmed_edges(docs, groups, classes, k, threshold, key, text)).withColumnRenamed("id", "class")
    out = spread_join(named, found, "class", "id", named.groupBy("class").agg(F.count("*").alias("n")), "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "class")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
