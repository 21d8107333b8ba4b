import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.sources.items import ITEM_SCHEMA, SourceError, check_schema, extent, file_changes, fingerprinted, open_source, picked_preview, since, with_file_facts
from quarry.sources.keyword_files import read_keywords, write_ascii_dump, write_keywords


@pytest.mark.parametrize(
    "files, count, body",
    [
        ('[{"path": "a/b", "size": 3}, {"path": "c", "size": "7"}]', 2, "a/b\nc"),
        ('{"path": "only", "size": 1}', 1, "only"),
        ('[{"path": 5}, {"path": ""}, {"size": 2}, {"path": "ok"}, 7, null]', 1, "ok"),
        ("not-a-json", 0, "not-a-json"),
        ("123", 0, ""),
        ("[]", 0, ""),
        ("", 0, ""),
        (None, 0, ""),
        ('"text"', 0, ""),
    ],
)
def test_file_facts(spark, files, count, body):
    row = with_file_facts(spark.createDataFrame([(1, files)], "id long, files string")).first()
    assert (row["file_count"], row["body"]) == (count, body)


def test_sizes_and_preview(spark):
    files = "[" + ",".join(f'{{"path": "p{i}", "size": {s}}}' for i, s in enumerate(["1", '"7"', '"x"', "null", "2.5", "1", "1", "1", "1", "1"])) + "]"
    row = with_file_facts(spark.createDataFrame([(1, files)], "id long, files string")).first()
    assert [f["size"] for f in row["file_list"]][:5] == [1.0, 7.0, 0.0, 0.0, 2.5]
    assert row["file_count"] == 10 and len(row["preview"]) == 8


def test_picked_preview(spark):
    files = [("Movie.mkv", 1.0), ("Sample/sample.txt", 2.0), ("sample movie.srt", 3.0)] + [(f"f{i}", 0.0) for i in range(4)]
    df = spark.createDataFrame([(files,)], "preview array<struct<path:string,size:double>>")
    shown = lambda ws: [f["path"] for f in df.select(picked_preview(F.col("preview"), ws)).first()[0]]
    assert shown(["sample", "movie"]) == ["sample movie.srt", "Movie.mkv", "Sample/sample.txt"]
    assert shown(["nothing"]) == []
    assert len(shown([])) == 5


def test_source(spark, tmp_path):
    with pytest.raises(SourceError):
        open_source(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(SourceError, match="name, infohash"):
        check_schema(spark.createDataFrame([], "id long"))
    spark.createDataFrame([(0, "a", None, None, None, 1, 1), (-3, "b", None, None, None, 1, 1)], ITEM_SCHEMA).write.parquet(str(tmp_path / "s"))
    source = open_source(spark, str(tmp_path / "s"))
    assert extent(source) == (-3, 0)
    assert extent(source.where("id > 5")) is None
    assert [r["id"] for r in since(source, -3).collect()] == [0]


def test_changes_of_equal_length_are_seen(spark):
    old = fingerprinted(spark.createDataFrame([(1, "aa"), (2, "bb"), (3, None)], "id long, files string"))
    new = spark.createDataFrame([(1, "aa"), (2, "cc"), (3, None), (0, "dd")], "id long, files string")
    found = file_changes(new, old)
    assert [r["id"] for r in found.new.collect()] == [0]
    assert [r["id"] for r in found.changed.collect()] == [2]


def test_keyword_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("﻿# header\nThe\n\n the \nMovie  # broad\n...\n日本\n", encoding="utf-8")
    terms = read_keywords(spark, str(tmp_path / "in.txt"))
    assert sorted(r[0] for r in terms.collect()) == ["movie", "the", "日本"]
    write_keywords(terms, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# keywords", "movie", "the", "日本"]
    stats = spark.createDataFrame([("a", 2, 3), ("é", 9, 9), ("b", 5, 5)], "term string, doc_count long, occurrences long")
    write_ascii_dump(stats, str(tmp_path / "dump"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()) == ["a\t2\t3", "b\t5\t5"]


def test_changes_are_looked_for_in_the_whole_table(spark, data):
    kinds = {r["kind"]: r["count"] for r in queries.file_changes(spark, data).groupBy("kind").count().collect()}
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(n / 8 < kinds[k] < n / 2 for k in ("new", "changed"))
    assert queries.file_changes(spark, data).where("kind = 'changed' and id >= 150").count() > 0


def test_elements_that_are_no_files(spark):
    from quarry.sources.items import parsed_files

    texts = ['[{"path":"a","size":1},5,"s",null,[{"path":"in"}],{"path":{"path":"q"}},{"path":true},{"size":4}]', '[{"path":"b","size":"abc"},{"path":"c","size":"1e3"},{"path":"d","size":{"a":1}},{"path":"e","size":"NaN"}]', '{"path":"f","more":[1]}', '{"path":1}', "1"]
    found = spark.createDataFrame(list(enumerate(texts)), "id long, files string").select("id", parsed_files(F.col("files")).alias("p")).collect()
    assert {r["id"]: [tuple(f) for f in r["p"]] for r in found} == {0: [("a", 1.0)], 1: [("b", 0.0), ("c", 1000.0), ("d", 0.0), ("e", 0.0)], 2: [("f", 0.0)], 3: [], 4: []}
