import random

import numpy as np
import pytest

from oracle import same
from quarry.llm import common
from quarry.llm import near_dedup as nd
from quarry.llm.components import components
from quarry.llm.queries import ORACLES, QUERIES
from quarry.llm.words import shingles, windows, word_hashes


def brute(texts, k, percent):
    """Smallest index reachable over exact links, on plain sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def mutated(rnd, base, rate):
    return [f"m{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in base]


def corpus(words, seed=3):
    rnd, texts = random.Random(seed), []
    for g in range(12):
        base = words(rnd.randint(3, 160), seed=100 + g)
        for _ in range(rnd.choice([1, 2, 5, 12])):
            texts.append(" ".join(mutated(rnd, base, rnd.choice([0, 0.005, 0.01, 0.03, 0.1]))))
    shared = " ".join(words(60, seed=999))
    texts += [" ".join(words(30, seed=500 + i)) + " " + shared for i in range(20)]
    texts += [None, "", " \n\t", "one", "ONE", "two words", "Two  Words\n", "é É", "x" * 5000, texts[0].upper(), texts[0]]
    return texts


@pytest.mark.parametrize("k, threshold", [(3, 0.85), (5, 0.8)])
def test_components_are_those_of_all_pairs(spark, words, k, threshold):
    texts = corpus(words)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, k, threshold).collect())
    assert got == brute(texts, k, round(threshold * 100))


def test_blocks_and_large_buckets_lose_nothing(spark, words, monkeypatch):
    texts = corpus(words, seed=4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(common, "SALTS", 4)
    monkeypatch.setattr(nd, "MAX_BUCKET", 3)
    got = sorted((r["doc_id"], r["component_id"]) for r in nd.near_duplicates(df, 3, 0.85).collect())
    assert got == [(i, c) for i, _, c in brute(texts, 3, 85)]


def test_defined_results(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (5, "a b c d"), (5, "a b c d"), (8, None), (9, ""), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", nd.F.lit("mine")).withColumn("KEPT", nd.F.lit(1))
    got = sorted((tuple(r) for r in nd.near_duplicates(df, 3, 0.85).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (7, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_runs():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in ([1, 1, 2], [2, 2, 2, 3], [], [3, 4])]
    assert [t.column(0).to_pylist() for t in nd._runs(iter(batches))] == [[1, 1], [2, 2, 2, 2], [3, 3], [4]]


def test_sketch_estimates_are_close():
    rnd = np.random.default_rng(2)
    n = nd.band_count(0.85) * nd.ROWS
    for share in (1.0, 0.95, 0.9, 0.85):
        errors = []
        for _ in range(30):
            both = rnd.integers(0, 2**63, 600, dtype=np.uint64)
            cut = round(600 * (1 - share) / 2 * 2 / (1 + share)) if share < 1 else 0
            a, b = both[cut:], both[: 600 - cut]
            true = (600 - 2 * cut) / 600
            x, y = (np.frombuffer(nd.odd_sketch(nd.samples(np.unique(s), n)), np.uint64) for s in (a, b))
            errors.append(nd.estimate(int(np.bitwise_count(x ^ y).sum()), n) - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < nd.MARGIN


def test_the_sketch_filter_loses_no_pair_at_the_threshold():
    """Pairs at exactly the threshold, each with samples of its own: a pair's samples agree with that probability."""
    rnd = np.random.default_rng(5)
    for threshold in (0.85, 0.8):
        n = nd.band_count(threshold) * nd.ROWS
        most = nd.most_differing_bits(threshold - nd.MARGIN, n)
        worst = 0
        for _ in range(4000):
            a = rnd.integers(0, 2**63, n, dtype=np.uint64)
            b = np.where(rnd.random(n) < threshold, a, rnd.integers(0, 2**63, n, dtype=np.uint64))
            x, y = (np.frombuffer(nd.odd_sketch(s), np.uint64) for s in (a, b))
            worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
        assert worst <= most


def test_sets_do_not_depend_on_slices(monkeypatch):
    from quarry.llm import words as w

    text = ("alpha beta  gamma\n\x0bdelta été " * 400).encode() + b"z" * 3000
    whole = word_hashes(text)
    monkeypatch.setattr(w, "SLICE", 50)
    assert np.array_equal(word_hashes(text), whole)
    assert len(whole) == len(text.split())
    assert len(set(whole.tolist())) == len(set(text.split()))
    assert len(shingles(whole[:2], 3)) == 1 and len(windows(whole[:2], 3)) == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in linked}


def test_query(spark, data):
    same(QUERIES["op3_near_dedup"](spark, data), ORACLES["op3_near_dedup"], data)
