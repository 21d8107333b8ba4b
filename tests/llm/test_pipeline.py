import inspect

import corpus_pipeline as cp
from pyspark.sql import functions as F

from quarry.llm import decontamination as dc
from quarry.llm import near_dedup as nd
from quarry.llm.quality_rules import BASE_RULES, RULES, Text


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "near_dedup", "decontamination", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)


def test_each_stage_against_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["doc_id"] in before}
            assert sum((i in kept[name]) == (y == 0) for i, y in labels.items()) >= 0.9 * len(labels)
            assert all(i in kept[name] for i, y in labels.items() if y == 0)
        elif name == "quality_rules":
            assert kept[name] == {i for i, t in before.items() if not any(r.rejects(Text(t)) for r in BASE_RULES + RULES)}
        elif name == "near_dedup":
            sets = {i: set(nd.text_shingles(t, 5).tolist()) for i, t in before.items()}
            root = {i: i for i in sets}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            order = sorted(sets)
            for n, i in enumerate(order):
                for j in order[:n]:
                    common = len(sets[i] & sets[j])
                    if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
            assert kept[name] == {i for i in sets if find(i) == i}
        else:
            items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert kept[name] == {i for i, t in before.items() if not any(x in t for x in items)}


def test_nulls_extra_columns_and_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 as kept", "'x' as predicted", "0 as score")
    rows = docs.limit(60).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars", "kept", "predicted", "score"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, data)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), data).count() == 0, name
        rows = out
    assert cp.packing(spark, rows, data).count() > 0
    assert dc.MIN_ITEM > 1


def test_every_stage_runs_once(spark, data, monkeypatch):
    """A document is scored once, and what a stage kept is read from what it wrote."""
    scored, written = spark.sparkContext.accumulator(0), []

    def counting(docs, model):
        @F.udf("int")
        def never(i):
            scored.add(1)
            return 0

        return docs.withColumn("predicted", never("doc_id"))

    monkeypatch.setattr(cp, "score", counting)
    keep = cp.checkpoint
    monkeypatch.setattr(cp, "checkpoint", lambda df: written.append(df.columns) or keep(df))
    assert cp.run(spark, data).count() > 0
    assert scored.value == spark.read.parquet(f"{data}/documents.parquet").count()
    assert len(written) == len(cp.STAGES) - 1


def test_of_repeated_rows_one_stays(spark, data, words):
    text = " ".join(words(80, seed=1))
    rows = [(1, text), (1, text), (2, text), (3, " ".join(words(80, seed=2))), (3, " ".join(words(80, seed=3))), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, cp.near_dedup(spark, docs, data).collect()), key=str)
    assert got == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)
