"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios (operator 10).

The features of a text are the distinct character n-grams (3 to 6 code points of the
lower-cased text, white space as one blank) by hash. Each feature is scaled by the
logarithm of the ratio of its rates in toxic and in other training texts, and a logistic
regression is fitted to the scaled features. Labels, language, source and ids are never
features.

The classifier is fitted on a bounded sample of the labelled rows, ``max_rows`` of them by a
hash of their ids, each with its whole text. Tasks count n-grams by label; the counts (one row for
each of the 2 ** BITS hashes at most) give the features; tasks then reduce each text to its features, and
only these (MAX_FEATURES numbers a text at most) reach the one task that fits. Scoring covers
every text whole.

Defined results: an empty or null text scores the model's bias; a very long text is taken whole, in
slices; without labels of both
kinds there are no features and the bias alone decides; rows with a null id or label are not
trained on; an id with several labels counts once, as toxic if any says so; of rows that share an id
one is trained on; repeated rows score alike; an empty table gives an empty result; other columns
pass through and the new ones give way where names clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_key, checkpoint, column, forget, free_name
from quarry.llm.words import numbers

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Labelled rows that the classifier is fitted on at most, whole texts of any length.
MAX_ROWS = 8000
#: Chosen, as the orders and the penalty, by threefold validation on labelled rows outside the held-out fold.
MAX_FEATURES = 2048
MIN_TEXTS = 4
SLICE = 1 << 19

_K = numbers(31, max(ORDERS)) | np.uint64(1)
_SALT = numbers(32, max(ORDERS) + 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_blanks = re.compile(r"\s+")


def gram_ids(text: str | None) -> Iterator[np.ndarray]:
    """Hashes below 2 ** BITS of a text's n-grams with repeats, in arrays of bounded size."""
    if not text:
        return
    text = " " + _blanks.sub(" ", text.lower()) + " "
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            total = total[: len(codes) - n + 1] + codes[n - 1 :] * _K[n - 1]
            if n in ORDERS:  # those that begin in this slice
                yield (((total[:SLICE] + _SALT[n]) * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)


def present(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text. ``flags``: all False, and again after it."""
    for ids in gram_ids(text):
        flags[ids] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    """bias, and for each kept feature its hash and weight (times its log-count ratio)."""

    bias: float
    features: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        """Hash to feature number plus 1; 0 for hashes that are no feature."""
        table = np.zeros(1 << BITS, np.int32)
        table[self.features] = np.arange(1, len(self.features) + 1)
        return table

    def score(self, text: str | None, table: np.ndarray, flags: np.ndarray) -> float:
        """flags: one False for each feature number, and again after it."""
        for ids in gram_ids(text):
            got = table[ids]
            flags[got[got > 0]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        z = self.bias + float(self.weights[found - 1].sum())
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def chosen(counts: np.ndarray, pos: int, neg: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept features' hashes, ascending, and their log-count ratios.

    ``counts``: texts of the other kind and of the toxic kind (rows) that hold each hash; ``pos`` and ``neg``: all texts of a kind.
    """
    ratio = np.log((counts[1] + 1) / (pos + 2)) - np.log((counts[0] + 1) / (neg + 2))
    n = counts.sum(0)
    mean = n / (pos + neg)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / pos + 1 / neg))
    strength = np.where(n >= MIN_TEXTS, np.abs(counts[1] / pos - counts[0] / neg) / spread, 0)
    kept = np.sort(np.argsort(-strength, kind="stable")[:MAX_FEATURES])
    kept = kept[strength[kept] > 0]
    return kept, ratio[kept]


def unfitted(pos: int, neg: int) -> Model:
    """What holds without texts of both kinds: no features, and never toxic."""
    return Model(min(float(np.log((pos + 0.5) / (neg + 1.0))), -2.0), np.zeros(0, np.int64), np.zeros(0))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """The classifier of texts in memory, by the steps of ``train``."""
    toxic = np.asarray(toxic, bool)
    pos, neg = int(toxic.sum()), int((~toxic).sum())
    if not pos or not neg:
        return unfitted(pos, neg)
    flags = np.zeros(1 << BITS, bool)
    counts = np.zeros((2, 1 << BITS), np.int64)
    for text, y in zip(texts, toxic, strict=True):
        counts[int(y), present(text, flags)] += 1
    kept, ratio = chosen(counts, pos, neg)
    return fitted([numbered(present(text, flags), kept) for text in texts], toxic, kept, ratio)


def numbered(found: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The numbers of those of the hashes that are kept features."""
    spots = np.searchsorted(kept, found)
    spots[spots == len(kept)] = 0
    return spots[kept[spots] == found].astype(np.int32) if len(kept) else np.zeros(0, np.int32)


def fitted(rows: list[np.ndarray], toxic: np.ndarray, kept: np.ndarray, ratio: np.ndarray, l2: float = 3.0, steps: int = 80) -> Model:
    """Logistic regression on the numbers of each text's features, each scaled by its log-count ratio."""
    prior = float(np.log((toxic.sum() + 0.5) / ((~toxic).sum() + 1.0)))
    ends = np.cumsum([len(x) for x in rows])
    cols = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    scale, y = ratio, toxic.astype(float)

    def sums(x: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0.0], np.cumsum(x)))
        return run[ends] - run[np.concatenate(([0], ends[:-1]))]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = v[1:] * scale
        z = v[0] + sums(w[cols])
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(cols, err[row], len(scale)) * scale
        value = float(np.sum(np.logaddexp(0, z) - y * z)) + l2 / 2 * float(v[1:] @ v[1:])
        return value, np.concatenate(([err.sum()], slope + l2 * v[1:]))

    v = minimum(loss, np.concatenate(([prior], np.zeros(len(scale)))), steps)
    return Model(float(v[0]), kept.astype(np.int64), v[1:] * scale)


def minimum(loss, v: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = loss(v)
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, g in reversed(pairs):
            a = (s @ way) / (s @ g)
            way -= a * g
            kept.append(a)
        if pairs:
            s, g = pairs[-1]
            way *= (s @ g) / (g @ g)
        else:
            way /= max(1.0, float(np.linalg.norm(way)))
        for (s, g), a in zip(pairs, reversed(kept), strict=True):
            way += s * (a - (g @ way) / (s @ g))
        gain, rate = float(slope @ way), 1.0
        if gain <= 0:
            break
        while True:
            new, (new_value, new_slope) = v - rate * way, loss(v - rate * way)
            if new_value <= value - 1e-4 * rate * gain or rate < 1e-6:
                break
            rate /= 2
        step, turn = new - v, new_slope - slope
        if step @ turn > 1e-12:
            pairs = [*pairs, (step, turn)][-memory:]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        v, value, slope = new, new_value, new_slope
        if done:
            break
    return v


def held_out(doc_id: Column) -> Column:
    """The fold that is never trained on: crc32 of the id's text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The classifier of the labelled rows outside the held-out fold.

    The sample (at most ``max_rows`` ids, so it may be broadcast) meets the texts in one scan.
    """
    own = labels.select(column(labels, key).alias("k"), column(labels, label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
    own = own.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(column(docs, key).alias("k"), F.coalesce(column(docs, text), F.lit("")).alias("x"))
    rows = rows.join(F.broadcast(own), "k").groupBy("k").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    sample = checkpoint(by_key(rows.select((F.col("y") == 1).alias("y"), "x", F.xxhash64("k").alias("place")), "place"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, counts = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[int(y), present(x.as_py(), flags)] += 1
        for y in (0, 1):
            found = np.flatnonzero(counts[y])
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(counts[y, found], pa.int64())], ["y", "gram", "n"])

    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = kinds.get(True, 0), kinds.get(False, 0)
    if not pos or not neg:
        return unfitted(pos, neg)
    sums = sample.select("y", "x").mapInArrow(counted, "y int, gram int, n long").groupBy("y", "gram").agg(F.sum("n").alias("n")).toArrow()  # 2 ** (BITS + 1) rows at most
    counts = np.zeros((2, 1 << BITS), np.int64)
    counts[sums.column("y").to_numpy(), sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    kept, ratio = chosen(counts, pos, neg)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = [numbered(present(x.as_py(), flags), kept) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["y", "place", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((p, y, np.asarray(f.values)) for b in batches for y, p, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))), key=lambda r: r[0])
        if rows:
            m = fitted([r[2] for r in rows], np.array([r[1] for r in rows], bool), kept, ratio)
            yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.weights.tobytes()])], ["bias", "weights"])

    got = sample.mapInArrow(reduced, "y boolean, place long, found array<int>").repartition(1).mapInArrow(run, "bias double, weights binary").first()
    forget(sample)
    return Model(got["bias"], kept.astype(np.int64), np.frombuffer(got["weights"], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold). One pass, no shuffle."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, flags = model.lookup(), np.zeros(len(model.features) + 1, bool)
        for batch in batches:
            yield pd.Series([model.score(x, table, flags) for x in batch], dtype="float64")

    name, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    out = docs.select("*", scored(column(docs, text)).alias(name))
    return out.withColumn(predicted, (F.col(name) >= threshold).cast("int"))
