import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity as tx
from quarry.llm.queries import QUERIES


def plain_grams(text):
    s = " " + tx._blanks.sub(" ", text.lower()) + " "
    return {s[i : i + n] for n in tx.ORDERS for i in range(len(s) - n + 1)}


def test_features_are_the_distinct_grams(monkeypatch):
    flags = np.zeros(1 << tx.BITS, bool)
    text = "Some text,\n\twith  Ünïcode 😀 and \n  more of it"
    whole = tx.present(text, flags)
    assert not flags.any()
    assert abs(len(whole) - len(plain_grams(text))) <= 1  # hashes may meet
    assert len(tx.present("", flags)) == 0 and len(tx.present(None, flags)) == 0
    every = np.sort(np.concatenate([*tx.gram_ids(text)]))
    for size in (1, 2, 7, 8):
        monkeypatch.setattr(tx, "SLICE", size)
        assert np.array_equal(np.sort(np.concatenate([*tx.gram_ids(text)])), every)


def test_ratios_and_choice_are_those_of_plain_counts(words, monkeypatch):
    """Against counts of the grams themselves, and a plain sum over them."""
    monkeypatch.setattr(tx, "MAX_FEATURES", 10**6)
    texts, labels = made(words, 80)
    model = tx.fit(texts, labels == 1)
    flags = np.zeros(1 << tx.BITS, bool)
    number = lambda g: int(((int(sum((ord(c) * int(k) for c, k in zip(g, tx._K)), 0) + int(tx._SALT[len(g)])) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - tx.BITS))
    held = [{number(g) for g in plain_grams(t)} for t in texts]
    assert all(set(tx.present(t, flags).tolist()) == h for t, h in zip(texts, held))
    pos, neg = int(labels.sum()), int((labels == 0).sum())
    toxic, other = ({}, {})
    for h, y in zip(held, labels):
        for g in h:
            kind = toxic if y else other
            kind[g] = kind.get(g, 0) + 1
    counts = np.zeros((2, 1 << tx.BITS), np.int64)
    for g in toxic.keys() | other.keys():
        counts[:, g] = other.get(g, 0), toxic.get(g, 0)
    kept, ratio = tx.chosen(counts, pos, neg)
    assert model.features.tolist() == kept.tolist()
    for g, r in list(zip(kept.tolist(), ratio.tolist()))[::97]:
        assert r == pytest.approx(math.log((toxic.get(g, 0) + 1) / (pos + 2) / ((other.get(g, 0) + 1) / (neg + 2))))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    seen = np.zeros(len(kept) + 1, bool)
    for t, h in zip(texts, held):
        z = model.bias + sum(weight.get(g, 0.0) for g in h)
        assert model.score(t, model.lookup(), seen) == pytest.approx(1 / (1 + math.exp(-max(min(z, 30), -30))))


def made(words, n=500, seed=2):
    rnd, texts, labels = random.Random(seed), [], []
    for i in range(n):
        w = words(rnd.randint(5, 200), seed=i)
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["grumbol", "zorkface", "blinket"]) + rnd.choice(["", "s", "ish"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_held_out_accuracy(words):
    texts, labels = made(words)
    model = tx.fit(texts[:400], labels[:400] == 1)
    table, flags = model.lookup(), np.zeros(len(model.features) + 1, bool)
    scores = np.array([model.score(t, table, flags) for t in texts[400:]])
    assert ((scores >= 0.5) == (labels[400:] == 1)).mean() >= 0.97
    assert 0 <= model.score("", table, flags) < 0.5
    assert model.score("you zorkfaced one", table, flags) > model.score("you fine one", table, flags)


def test_one_kind_of_label_only():
    model = tx.fit(["a b c"] * 5, np.zeros(5, bool))
    assert model.score("x", model.lookup(), np.zeros(1, bool)) < 0.5
    assert len(tx.fit([], np.zeros(0, bool)).features) == 0


def test_end_to_end(spark, words):
    texts, labels = made(words, 300)
    rows = list(enumerate(texts)) + [(None, "zorkface"), (5000, None), (5001, ""), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(1))
    marks = [(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None), (4, 1 - int(labels[4])), (4, int(labels[4]))]
    model = tx.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = tx.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "toxic", "score_", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score_"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95
    assert tx.score(docs.limit(0), model).count() == 0
    none = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in tx.score(docs, none).collect()} == {0}


def test_query(spark, data):
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, data).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.9


def test_precision_and_recall_on_rows_never_trained_on(spark):
    """On the held-out fold of a larger table, where "never toxic" would find nothing."""
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["predicted"] for r in QUERIES["op10_toxicity"](spark, folder).where("held_out").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in got}
    hits = sum(got[i] and labels[i] for i in labels)
    assert sum(labels.values()) >= 20
    assert hits >= 0.85 * sum(labels.values()) and hits >= 0.95 * sum(got[i] for i in labels)


def test_training_is_that_of_texts_in_memory(spark, words):
    texts, labels = made(words, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int"))
    own = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    plain = tx.fit([texts[i] for i in own], labels[own] == 1)
    assert model.features.tolist() == plain.features.tolist()
    assert model.weights == pytest.approx(plain.weights, abs=0.02)


def test_long_texts_are_fitted_on(spark, words):
    texts = [" ".join(words(30, seed=i)) + (" zorkface grumbol" + " and so on" * 20_001 if i % 3 == 0 else "") for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert min(len(x) for x in texts[::3]) > 200_000
    model = tx.train(d, labels)
    flags = np.zeros(len(model.features) + 1, bool)
    scores = [model.score(x, model.lookup(), flags) for x in texts]
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in enumerate(scores))
