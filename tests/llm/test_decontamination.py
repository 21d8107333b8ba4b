import random

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import decontamination as dc
from quarry.llm.queries import QUERIES


def brute(doc, item):
    """The best overlap over every diagonal: (matches, -length) and where."""
    best = (0, 0, 0)
    for diagonal in range(-len(item) + 1, len(doc)):
        start, length, matches = dc.overlap(doc, item, diagonal)
        if (matches, -length, -start) > (best[2], -best[1], -best[0]):
            best = (start, length, matches)
    return best


def corpus(words):
    rnd = random.Random(8)
    items = {i: words(rnd.randint(10, 60), seed=900 + i) for i in range(12)}
    items[50] = items[3]
    items[60] = words(5, seed=77)
    docs = {}
    for n in range(60):
        w = words(rnd.randint(0, 150), seed=n)
        if n % 3 == 0:
            item = list(items[rnd.randrange(12)])
            for _ in range(rnd.choice([0, 0, 1, 2, len(item) // 8])):
                item[rnd.randrange(len(item))] = f"sub{rnd.randrange(999)}"
            at = rnd.randint(0, len(w))
            w[at:at] = item if n % 2 else item[: max(14, len(item) // 2)]
        docs[n] = " ".join(w) if n % 4 else ", ".join(w).upper()
    docs |= {100: None, 101: "", 102: "...", 103: " ".join(items[60]), 104: " ".join(items[1]) * 2 + " " + " ".join(items[1])}
    return items, docs


def test_overlaps_are_those_of_all_diagonals(spark, words):
    items, docs = corpus(words)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["length"], r["matches"]) for r in dc.overlaps(d, b).collect()}
    expected = {}
    for i, w in items.items():
        item = dc.tokens(" ".join(w))
        if len(item) < dc.MIN_ITEM or i == 50:
            continue
        for n, text in docs.items():
            best = brute(dc.tokens(text), item)
            if dc.enough(best[2], best[1], len(item)):
                expected[n, i] = best
    assert got == expected and len(expected) >= 15
    clean = {r["doc_id"] for r in dc.decontaminate(d, b).collect()}
    assert clean == set(docs) - {n for n, _ in expected}


def test_substitutions_are_tolerated(words):
    """Any one substituted token in 14 leaves a hit of some mask, and so do most pairs."""
    item = dc.tokens(" ".join(words(14, seed=4)))
    own = [set(dc.seeds(item, m).tolist()) for m in range(len(dc.MASKS))]
    hit = lambda x: any(own[m] & set(dc.seeds(x, m).tolist()) for m in range(len(dc.MASKS)))

    def with_changes(spots):
        x = item.copy()
        x[list(spots)] = np.arange(len(spots), dtype=np.uint64)
        return x

    assert all(hit(with_changes([i])) for i in range(14))
    pairs = [(i, j) for i in range(14) for j in range(i)]
    assert sum(hit(with_changes(p)) for p in pairs) >= 0.7 * len(pairs)


def test_recall_of_seeds_at_every_length():
    """Of overlaps that count as such, with as many substitutions as that allows, nine in ten at least hold a seed."""
    rnd = np.random.default_rng(7)
    for length in [*range(dc.MIN_ITEM, 24), 32, 48, 64]:
        found = total = 0
        while total < 400:
            item = rnd.integers(0, 2**62, length, dtype=np.uint64)
            doc = item.copy()
            spots = rnd.choice(length, rnd.integers(1, length // 4 + 2), replace=False)
            doc[spots] = rnd.integers(0, 2**62, len(spots), dtype=np.uint64)
            _, n, matches = dc.overlap(doc, item, 0)
            if not dc.enough(matches, n, length):
                continue
            total += 1
            masks = range(len(dc.MASKS) if length < dc.SHORT_ITEM else len(dc.MASKS) - 1)
            found += any(np.any(dc.seeds(doc, m) == dc.seeds(item, m)) for m in masks)
        assert found >= 0.95 * total, (length, found, total)


def test_ids_of_any_type_and_hot_passages(spark, words, monkeypatch):

    monkeypatch.setattr(common, "HEAVY", 2)
    monkeypatch.setattr(common, "SALTS", 4)
    text = " ".join(words(20, seed=3))
    d = spark.createDataFrame([(f"d{i}", text if i < 9 else "clean " * 20) for i in range(12)], "doc_id string, text string")
    b = spark.createDataFrame([("q1", text), ("q2", text + " and more"), (None, None)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in dc.overlaps(d, b).collect()}
    assert got == {(f"d{i}", q, 20) for i in range(9) for q in ("q1", "q2")}


def test_shared_passages_are_no_leaks(spark, words):
    shared = " ".join(words(60, seed=1))
    d = spark.createDataFrame([(i, shared + " " + " ".join(words(20, seed=i))) for i in range(10, 20)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words(40, seed=2)))], "item_id long, text string")
    assert dc.overlaps(d, b).count() == 0
    assert dc.decontaminate(d, b).count() == 10


def test_short_items_are_found_as_whole_lines(spark, tmp_path):
    docs = [(1, "What is two plus two?"), (2, "before it\n\nWHAT is, two plus two\r\nafter"), (3, "they ask what is two plus two often"), (4, "what is\ntwo plus two"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, "What is two plus two?"), (8, "..."), (9, None)], "item_id long, text string")
    got = {tuple(r) for r in dc.overlaps(d, b, short=True).collect()}
    assert got == {(1, 7, 0, 5, 5, 5), (2, 7, 2, 5, 5, 5), (4, 7, 0, 5, 5, 5)}
    assert dc.overlaps(d, b).count() == 0
    d.write.parquet(str(tmp_path / "documents.parquet"))
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, str(tmp_path)).collect()} == {1, 2, 4}
    assert {r["doc_id"] for r in cp.decontamination(spark, d, str(tmp_path)).collect()} == {3, 5}


def test_a_word_on_a_line_is_no_leak(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)  # a line that many have is one key
    docs = [(1, "Is it?\nYes.\nIt is, and so on."), (2, "yes"), (3, "A B C\nmore text"), (4, " a\nb, c "), *((i, "Said he:\nWhat is two and two") for i in range(5, 12))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, "Yes."), (8, "a b c"), (9, "what is two and two?")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.overlaps(d, b, short=True).collect()}
    assert got == {(2, 7), (4, 8), *((i, 9) for i in range(5, 12))}


def test_empty_and_null(spark):
    d = spark.createDataFrame([(None, "a b c d e f g h i j k l m n"), (1, None)], "doc_id long, text string")
    b = spark.createDataFrame([(None, None), (2, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert [tuple(r) for r in dc.overlaps(d, b).collect()] == [(None, 2, 0, 14, 14, 14)]
    assert dc.decontaminate(d, b).count() == 2
    assert dc.overlaps(d, b.limit(0)).count() == 0 and dc.overlaps(d.limit(0), b).count() == 0


def test_leaks_go_whatever_their_id(spark, tmp_path):
    leak = "a b c d e f g h i j k l m n"
    d = spark.createDataFrame([("x", None, leak), ("y", None, "clean text"), ("z", None, None), ("u", 1, leak), ("v", 42, leak), ("w", 2, "clean")], "`my.name` string, doc_id long, text string")
    b = spark.createDataFrame([(2, leak)], "item_id long, text string")
    assert {r[0] for r in dc.decontaminate(d, b, by_row=True).collect()} == {"y", "z", "w"}
    assert dc.decontaminate(d, b, by_row=True).columns == d.columns
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r[0] for r in cp.decontamination(spark, d.withColumnRenamed("my.name", "name"), str(tmp_path)).collect()} == {"y", "z", "w"}


def test_query(spark, data):
    """Against verbatim containment, over the whole small tables."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    expected = {(d["doc_id"], i["item_id"]) for d in docs for i in items if d["text"] and i["text"] and i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, data).collect()}
    assert expected and got == expected
