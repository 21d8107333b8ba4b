import random

import pytest
from pyspark.sql import functions as F

from oracle import same
from quarry.llm import warc_fixity as wf
from quarry.llm.queries import ORACLES, QUERIES


def records(spark, n=300):
    rnd = random.Random(1)
    return spark.createDataFrame([(i, f"record {i} é " + "x" * rnd.randint(0, 50)) for i in range(n)], "id long, record string")


def changed(df, rules):
    body = F.col("record")
    for i, f in rules.items():
        body = F.when(F.col("id") == i, f(body)).otherwise(body)
    return df.withColumn("record", body)


def test_damage_is_located(spark):
    df = records(spark)
    bad = {7, 150, 299}
    replica = changed(df, {i: lambda b: F.overlay(b, F.lit("#"), F.lit(3)) for i in bad})
    got = wf.audit(df, replica, archive_bytes=2000, fanout=3).collect()
    assert len(got) == 300 and {r["id"] for r in got if not r["intact"]} == bad
    assert all((r["digest"] == r["replica_digest"]) == r["intact"] for r in got)
    assert len({r["archive"] for r in got}) > 3
    for a in {r["archive"] for r in got}:
        own = sorted((r["ordinal"], r["first"], r["last"]) for r in got if r["archive"] == a)
        assert [o[0] for o in own] == list(range(len(own))) and [o[1] for o in own] == [0] + [o[2] for o in own[:-1]]


def test_descends_only_below_what_differs(spark):
    df = records(spark)
    mine = wf.leaves(df, 1).cache()
    depth = wf.tree_depth(mine, 4)
    assert 4**depth >= 300 > 4 ** (depth - 1)
    tree = wf.nodes(mine, depth, 4).cache()
    assert tree.where(F.col("level") == depth).count() == 1
    other = wf.nodes(wf.leaves(changed(df, {40: lambda b: F.overlay(b, F.lit("#"), F.lit(1))}), 1), depth, 4).cache()
    both = tree.join(other.withColumnRenamed("hash", "theirs"), ["archive", "level", "place"]).where("hash <> theirs")
    assert both.count() == depth + 1  # one path from the root to the leaf
    assert wf.mismatches(tree, other, depth, 4).count() == 1
    assert wf.mismatches(tree, tree, depth, 4).count() == 0


def test_missing_and_moved_records(spark):
    df = records(spark, 50)
    assert {r["id"] for r in wf.audit(df, df.where("id < 49"), archive_bytes=10**6).collect() if not r["intact"]} == {49}
    gone = wf.audit(df.where("id < 49"), df, archive_bytes=10**6).where("not intact").collect()
    assert [(r["id"], r["digest"]) for r in gone] == [(49, None)]
    longer = wf.audit(df, changed(df, {30: lambda b: F.concat(b, F.lit("!"))}), archive_bytes=10**6).where("not intact")
    assert {r["id"] for r in longer.collect()} == set(range(30, 50))  # what follows has moved
    assert longer.where("digest <> replica_digest").count() == 1
    assert {(r["id"], r["status"]) for r in longer.collect()} == {(30, "damaged"), *((i, "moved") for i in range(31, 50))}
    assert gone[0]["status"] == "extra"


def test_what_went_and_came_in_between(spark):
    df = records(spark, 40)
    got = wf.audit(df.where("id <> 7"), df.where("id <> 20"), archive_bytes=10**6).collect()
    by = {r["id"]: r["status"] for r in got}
    assert len(got) == 40 and by[20] == "missing" and by[7] == "extra"
    assert {i for i, x in by.items() if x == "moved"} >= set(range(8, 20))  # behind what came in, before what went
    assert all(by[i] == "intact" for i in range(7))
    assert all(by[i] in ("intact", "moved") for i in by if i not in (7, 20))


def test_records_without_an_id_do_not_meet_in_one_archive(spark):
    df = records(spark).withColumn("id", F.lit(None).cast("long"))
    replica = df.withColumn("record", F.when(F.col("record").startswith("record 7 "), F.overlay("record", F.lit("#"), F.lit(3))).otherwise(F.col("record")))
    got = wf.audit(df, replica, archive_bytes=2000, fanout=3)
    assert got.count() == 300 and got.select("archive").distinct().count() > 3
    assert got.where("digest <> replica_digest and status in ('damaged', 'missing')").count() == 1


def test_the_plan_does_not_grow_with_the_depth(spark):
    df = records(spark, 80)

    def joins(fanout):
        return wf.audit(df, df, archive_bytes=10**6, fanout=fanout)._jdf.queryExecution().executedPlan().toString().count("Join")

    assert joins(2) == joins(80)


def test_defined_results(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "id long, record string").withColumn("hash", F.lit("mine"))
    got = wf.audit(df, df).collect()
    assert len(got) == 4 and all(r["intact"] for r in got)
    assert wf.audit(df.limit(0), df.limit(0)).count() == 0
    assert wf.audit(df.limit(0), df).where("not intact").count() == 4


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 3 else f"<p>é {i}\n\r\n</p>" * i) for i in range(20)], "id long, url string, html string")
    kept = pages.select("id", wf.warc_record(F.col("url"), F.col("html")).alias("record"))
    n = wf.archive_count(kept, archive_bytes=1500)
    assert n > 1
    wf.write_archives(kept, str(tmp_path / "w"), n)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path / "w"))
    read = wf.read_archives(files).collect()
    pages = {r["url"]: (r["html"] or "").encode() for r in pages.collect()}
    assert {r["uri"]: bytes(r["payload"]) for r in read} == pages
    spans = {(r["first"], r["last"]) for r in wf.leaves(kept, n).collect()}
    assert {(r["first"], r["last"]) for r in read} <= spans and len(read) == 20


def test_a_damaged_file_is_read_to_its_end(spark):
    files = spark.createDataFrame([("p", bytearray(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\njunk")), ("q", bytearray(b""))], "path string, content binary")
    assert [(r["ordinal"], r["first"], r["last"], r["payload"] and bytes(r["payload"])) for r in wf.read_archives(files).collect()] == [(0, 0, 37, b"ab"), (1, 37, 41, None)]


@pytest.mark.parametrize("name", ["op9_warc_fixity"])
def test_query(spark, data, name):
    same(QUERIES[name](spark, data), ORACLES[name], data)
