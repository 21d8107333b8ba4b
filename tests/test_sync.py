import json
import time

import pytest

from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.sources.items import ITEM_SCHEMA, SourceError
from quarry.streaming import sync
from quarry.streaming.store import FORMAT
from quarry.streaming.sync import Busy


def item(i, name, files, size=100, at=1000):
    h = "hash" + str(i).zfill(40)
    return (i, name, h, "magnet:?xt=urn:btih:" + h, files if isinstance(files, str) else json.dumps([{"path": p, "size": s} for p, s in files]), size, at)


FIRST = [item(0, "Zero.Day.mkv", [("Zero.Day.mkv", 10)]), item(2, "Some Movie 2024", [("Movie.mkv", 70), ("Sample/sample.txt", 5)], 75), item(3, "Broken", "not-a-json", 1)]
SECOND = [item(5, "Second Movie", [("second.flac", 3)], 3, 2000), item(9, "Third", "[]", 4, 3000)]


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), hot_min_docs=1)
    e.rebuild(spark.createDataFrame(FIRST, ITEM_SCHEMA))
    return e


def found(engine, query, **more):
    return [r["id"] for r in engine.search(query=query, **more).items]


def test_rebuild_then_sync(spark, engine):
    assert found(engine, "movie") == [2]
    assert found(engine, "json") == [3]  # text that is no list is searched as it is
    assert engine.count() == 3
    row = engine.search(query="sample").items[0]
    assert sorted(row) == ["fetched_at", "file_count", "id", "infohash", "magnet", "name", "preview", "total_size"]
    assert [f["path"] for f in row["preview"]] == ["Sample/sample.txt"]
    result = engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    assert (result.rows, result.span, result.skipped) == (2, 6, False)
    assert found(engine, "movie") == [5, 2] and engine.search(query="movie").total == 2
    again = engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    assert (again.rows, again.span) == (0, 0)
    assert [r["id"] for r in engine.latest(2).items] == [9, 5]
    assert found(engine, "hash" + "5".zfill(40), by="hash") == [5]


def test_sync_by_sync_is_a_rebuild(spark, engine, tmp_path):
    engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.rebuild(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    same_rows(engine, whole)
    scores = lambda e: [(r["id"], round(r["score"], 9)) for r in e.search(query="movie", sort_by="relevance").items]
    assert scores(engine) == scores(whole)
    before = engine.search(query="m", limit="all").items
    engine.runs.compact(least_rows=4)
    assert engine.stats()["segments"] == 1
    assert engine.search(query="m", limit="all").items == before


def test_changes_and_deletions_need_a_rebuild(spark, engine):
    changed = [item(2, "Renamed", [("x.mkv", 1)]), item(3, "Broken", "not-a-json")]
    engine.sync(spark.createDataFrame(changed, ITEM_SCHEMA))
    assert found(engine, "movie") == [2]
    engine.rebuild(spark.createDataFrame(changed, ITEM_SCHEMA))
    assert found(engine, "movie") == [] and found(engine, "renamed") == [2] and engine.count() == 2


def same_rows(one, other):
    for part in ("docs", "postings", "files"):
        key = lambda e: sorted(map(str, e.read(part).select(sorted(e.read(part).columns)).collect()))  # noqa: E731, B023
        assert key(one) == key(other), part
    assert one.index().corpus.collect() == other.index().corpus.collect()
    assert sorted(map(str, one.keywords.stats().collect())) == sorted(map(str, other.keywords.stats().collect()))


def test_refresh_takes_over_changed_file_lists(spark, engine, tmp_path):
    engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    before = engine.store.manifest()
    later = [item(0, "Zero.Day.mkv", [("Zero.Day.mkv", 10)]), item(2, "Some Movie 2024", [("Other.flac", 9), ("Other.txt", 1)], 10), FIRST[2], *SECOND, item(11, "Late", "[]")]
    source = spark.createDataFrame(later, ITEM_SCHEMA)
    result = engine.refresh(source)
    assert (result.kind, result.rows, result.replaced) == ("refresh", 1, 1)
    kept = engine.store.manifest()
    assert kept.segments[:2] == before.segments and len(kept.segments) == 3 and kept.watermark == 9
    assert found(engine, "other") == [2] and found(engine, "sample") == [] and engine.count() == 5
    assert [n["name"] for n in engine.file_tree(2)] == ["Other.flac", "Other.txt"]
    assert engine.refresh(source).rows == 0 and engine.store.manifest() == kept
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.rebuild(source.where("id < 11"))
    same_rows(engine, whole)
    assert found(engine, "late") == [] and engine.sync(source).rows == 1 and found(engine, "late") == [11]


def test_appended_items_replace_stored_ones(spark, engine, tmp_path):
    source = spark.createDataFrame(FIRST, ITEM_SCHEMA)
    result = engine.runs.append(source, 0, "x")
    assert (result.rows, result.replaced) == (3, 3)
    assert engine.count() == 3
    page = engine.search(query="m", limit=12)
    assert [r["id"] for r in page.items] == [2, 0] and page.total == 2
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.rebuild(source)
    same_rows(engine, whole)
    # A renamed item, and one that says nothing any more; then all of it compacted, and once more replaced.
    renamed = [item(2, "Renamed words", [("x.mkv", 1)]), item(3, "", "")]
    engine.runs.append(spark.createDataFrame(renamed, ITEM_SCHEMA), 1, "x")
    expected = spark.createDataFrame([FIRST[0], *renamed], ITEM_SCHEMA)
    whole.rebuild(expected)
    same_rows(engine, whole)
    assert found(engine, "movie") == [] and found(engine, "renamed") == [2] and engine.keywords.ranking() is None
    assert engine.runs.compact(least_rows=4).rows == 3
    assert len(engine.store.manifest().segments) == 1 and engine.keywords.ranking() is not None
    same_rows(engine, whole)
    engine.runs.append(spark.createDataFrame([FIRST[1], FIRST[1][:1] + ("Older", *FIRST[1][2:6], 1)], ITEM_SCHEMA), 2, "x")  # of two rows the one fetched last
    whole.rebuild(spark.createDataFrame([FIRST[0], FIRST[1], renamed[1]], ITEM_SCHEMA))
    same_rows(engine, whole)


def test_two_drivers_on_one_store(spark, engine, tmp_path):
    """Each commits while the other is between writing and committing; nothing is lost, and ids stay single."""
    other = Engine(spark, engine.store.root)
    write = engine.runs.write_segment

    def late(*args):
        made = write(*args)
        engine.runs.write_segment = write
        other.runs.append(spark.createDataFrame([item(50, "Other driver", "[]"), item(2, "Other name", "[]")], ITEM_SCHEMA), 0, "b")
        return made

    engine.runs.write_segment = late
    engine.runs.append(spark.createDataFrame([item(60, "One driver", "[]"), item(2, "One name", "[]")], ITEM_SCHEMA), 0, "a")
    assert sorted(r["id"] for r in engine.read("docs").select("id").collect()) == [0, 2, 3, 50, 60]
    assert found(other, "driver") == [60, 50] and found(other, "name") == [2] and found(engine, "other name") == [] and other.count() == 5
    # A rebuild during which the other driver appends: what came meanwhile stays, and replaces.
    engine.runs.write_segment = late
    other_rows = engine.store.manifest().batches["b"]
    assert other_rows == 0
    whole = [*FIRST, item(50, "Stale", "[]")]

    def later(*args):
        made = write(*args)
        engine.runs.write_segment = write
        other.runs.append(spark.createDataFrame([item(50, "Fresh words", "[]")], ITEM_SCHEMA), 1, "b")
        return made

    engine.runs.write_segment = later
    engine.rebuild(spark.createDataFrame(whole, ITEM_SCHEMA))
    assert found(engine, "stale") == [] and found(engine, "fresh") == [50] and engine.count() == 4
    assert engine.store.manifest().batches == {"a": 0, "b": 1}


def test_a_state_is_created_once(spark, tmp_path):
    from quarry.streaming.store import Files

    files = Files(spark, str(tmp_path / "store"))
    assert files.create("states/1.json", "one") and not files.create("states/1.json", "two")
    assert files.read("states/1.json") == "one" and list(files.children("states")) == ["1.json"]


def test_segments_grow_with_the_logarithm_of_batches(spark, tmp_path):
    from quarry.streaming.store import Manifest, Segment
    from quarry.streaming.sync import Sync

    state, most = Manifest(), 0
    for i in range(1000):
        state = Manifest(segments=(*state.segments, Segment(f"s{i}", i, i + 1, 10)))
        while own := Sync.due(state):
            rest = tuple(s for s in state.segments if s not in own)
            state = Manifest(segments=(*rest, Segment("+".join(str(s.rows) for s in own) + f"at{i}", own[0].low, own[-1].high, sum(s.rows for s in own))))
        most = max(most, len(state.segments))
    assert sum(s.rows for s in state.segments) == 10_000 and most <= 3 * 6


def test_refresh_of_a_store_without_data_builds_it(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.refresh(spark.createDataFrame(FIRST, ITEM_SCHEMA)).kind == "rebuild" and e.count() == 3
    assert e.refresh(spark.createDataFrame([], ITEM_SCHEMA)).rows == 0 and e.count() == 3


@pytest.mark.parametrize("more", [{}, {"order": "asc"}, {"sort_by": "relevance"}, {"sort_by": "totalSize"}, {"min_size": 3, "max_size": 75}, {"limit": 1, "offset": 1}, {"limit": "all"}])
def test_pages_of_the_index_are_those_of_a_scan(spark, engine, more):
    from quarry.operators.search import search
    from quarry.sources.items import with_file_facts

    engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    items = with_file_facts(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    plain = lambda r: ([(x["id"], round(x.get("score", 0.0), 9)) for x in r.items], r.total, r.truncated, r.next_cursor)
    own = search(engine.read("docs"), {"query": "m"} | more, index=engine.index())
    assert plain(own) == plain(search(items, {"query": "m"} | more))
    if own.next_cursor:
        on = {"query": "m", "cursor": own.next_cursor} | more
        assert plain(search(engine.read("docs"), on, index=engine.index())) == plain(search(items, on))


def test_a_failed_rebuild_changes_nothing(spark, engine):
    with pytest.raises(SourceError):
        engine.rebuild(spark.createDataFrame([(1,)], "id long"))
    bad = spark.createDataFrame(FIRST, ITEM_SCHEMA).selectExpr("id", "cast(raise_error('lost') as string) name", "infohash", "magnet", "files", "total_size", "fetched_at")
    with pytest.raises(Exception, match="lost"):
        engine.rebuild(bad)
    assert found(engine, "movie") == [2]
    engine.store.clean()
    assert found(engine, "movie") == [2]


def test_one_run_at_a_time(spark, engine):
    engine.runs._lock.acquire()
    try:
        assert engine.sync(spark.createDataFrame(FIRST, ITEM_SCHEMA)).skipped
        with pytest.raises(Busy):
            engine.rebuild(spark.createDataFrame(FIRST, ITEM_SCHEMA))
    finally:
        engine.runs._lock.release()


def test_a_store_of_another_format_is_rebuilt(spark, engine):
    text = engine.store.files.read("states/1.json").replace(f'"format": "{FORMAT}"', '"format": "0"')
    assert engine.store.files.create("states/9.json", text)
    assert engine.sync(spark.createDataFrame(SECOND, ITEM_SCHEMA)).kind == "rebuild"
    assert engine.count() == 2


def test_stream(spark, engine, tmp_path):
    place = str(tmp_path / "arriving")
    spark.createDataFrame(SECOND[:1], ITEM_SCHEMA).write.parquet(place)
    run = lambda: engine.runs.stream(spark.readStream.schema(ITEM_SCHEMA).parquet(place), str(tmp_path / "marks")).awaitTermination()
    run()
    assert found(engine, "second") == [5]
    spark.createDataFrame(SECOND[1:], ITEM_SCHEMA).write.mode("append").parquet(place)
    run()
    run()
    assert engine.count() == 5 and found(engine, "third") == [9]
    (stream,) = engine.store.manifest().batches
    told = engine.stats()["streams"][stream]  # what the listener heard may come a little later
    assert (told["items"], told["replaced"], told["span"]) == (2, 0, (5, 9)) and {"items", "replaced", "span"} <= set(told)
    for _ in range(100):
        told = engine.stats()["streams"][stream]
        if told.get("active") is False:
            break
        time.sleep(0.1)
    assert told["active"] is False and told["error"] is None and told["batch"] >= 1 and "rows_per_second" in told
    assert engine.runs.append(spark.createDataFrame(SECOND, ITEM_SCHEMA), 0, stream).skipped
    engine.rebuild(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    assert engine.runs.append(spark.createDataFrame(SECOND, ITEM_SCHEMA), 0, stream).skipped  # a replay after a rebuild
    assert engine.count() == 5


def test_streams_are_told_apart(spark, engine, tmp_path):
    for i, rows in enumerate((SECOND[:1], SECOND[1:])):  # each its own stream, both begin with batch 0
        place = str(tmp_path / f"arriving{i}")
        spark.createDataFrame(rows, ITEM_SCHEMA).write.parquet(place)
        engine.runs.stream(spark.readStream.schema(ITEM_SCHEMA).parquet(place), str(tmp_path / f"marks{i}")).awaitTermination()
    assert engine.count() == 5 and len(engine.store.manifest().batches) == 2


def test_readers_of_the_last_state_keep_their_segments(spark, engine):
    before = engine.read("docs")
    engine.rebuild(spark.createDataFrame(SECOND, ITEM_SCHEMA))
    assert before.count() == 3 and engine.count() == 2


def test_suggestions_and_statistics(engine):
    assert engine.suggest("mov") == ["movie", "mkv"] and engine.suggest("...") == []
    engine.search(query="movie"), engine.search(query="movie")
    own = engine.stats()
    assert own["hits"] == 1 and 0 < own["hit_rate"] < 1 and own["step"] is None


def test_keywords_outlive_rebuilds(spark, engine, tmp_path):
    assert engine.keywords.add(["Movie", " movie ", "...", "day"]) == 2
    assert engine.keywords.add(["movie"]) == 0
    assert {r["term"] for r in engine.keywords.top(min_docs=1).collect()} == {"zero", "some", "broken", "mkv"}
    engine.rebuild(spark.createDataFrame(FIRST, ITEM_SCHEMA))
    assert [r["term"] for r in engine.keywords.filters().collect()] == ["day", "movie"]
    engine.keywords.remove("MOVIE")
    assert "movie" in {r["term"] for r in engine.keywords.top(min_docs=1).collect()}
    engine.keywords.save(str(tmp_path / "list"))
    engine.keywords.remove("day")
    assert engine.keywords.load(str(tmp_path / "list")) == 1
    (tmp_path / "more").write_text("# head\nDay\nday # again\nnew one\n\n...\n")
    assert tuple(engine.keywords.import_terms(str(tmp_path / "more"))) == (1, 2, 2)
    assert tuple(engine.keywords.import_terms(str(tmp_path / "more"))) == (0, 2, 2)


def test_the_log_of_the_filter_list_is_merged(spark, tmp_path, monkeypatch):
    own = Engine(spark, str(tmp_path / "store")).keywords
    own.add(["one", "two", "three"])
    own.remove("two")
    own.add(["four"])
    before = own.filters().collect()
    monkeypatch.setattr("quarry.engine.LOG_FILES", 2)
    assert own.compact() == 0  # too young
    monkeypatch.setattr("quarry.engine.LOG_SECONDS", -1)
    assert own.compact() == 3 and own.filters().collect() == before and own.filtered() == {"one", "three", "four"}
    assert own.add(["two"]) == 1 and own.add(["two"]) == 0


def test_one_file_is_opened_for_an_item(spark, tmp_path, monkeypatch):
    from quarry.streaming import sync

    monkeypatch.setattr(sync, "SLOT_ROWS", 10)
    rows = [item(3 * i, f"Name {i}", [(f"f{i}.mkv", i)]) for i in range(-20, 45)]
    e = Engine(spark, str(tmp_path / "store"), hot_min_docs=1)
    e.rebuild(spark.createDataFrame(rows, ITEM_SCHEMA))
    assert len(e.read("files").inputFiles()) > 4
    for i in (-60, 0, 33, 132):
        assert len(e.store.looked_up([i]).inputFiles()) == 1
        assert [n["name"] for n in e.file_tree(i)] == [f"f{i // 3}.mkv"]
    assert e.file_tree(1) is None and e.file_tree(10**9) is None and e.file_tree(-61) is None
    e.runs.append(spark.createDataFrame([item(33, "Else", [("else.flac", 1)])], ITEM_SCHEMA), 0)
    assert [n["name"] for n in e.file_tree(33)] == ["else.flac"] and [n["name"] for n in e.file_tree(36)] == ["f12.mkv"]
    page = e.search(query="name", limit=3, sort_by="id", order="asc").items
    assert [[f["path"] for f in r["preview"]] for r in page] == [[], [], []] and e.latest(1).items[0]["preview"] == [{"path": "f44.mkv", "size": 44.0}]


def test_file_tree(engine):
    nodes = engine.file_tree(2)
    assert [(n["name"], n["parent"], n["is_dir"], n["size"]) for n in nodes] == [("Movie.mkv", -1, False, 70.0), ("Sample", -1, True, 5.0), ("sample.txt", 1, False, 5.0)]
    assert engine.file_tree(3) == [] and engine.file_tree(999) is None


def test_empty_source(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.rebuild(spark.createDataFrame([], ITEM_SCHEMA)).rows == 0
    assert e.stats()["items"] == 0
    e.sync(spark.createDataFrame(SECOND, ITEM_SCHEMA))
    assert e.count() == 2


def test_pages_are_remembered_until_the_state_changes(spark, engine):
    first = engine.search(query="movie", tag="one")
    assert engine.search(query="movie") is first
    assert engine.search(query="movie", limit="all") is not engine.search(query="movie", limit="all")
    engine.sync(spark.createDataFrame(FIRST + SECOND, ITEM_SCHEMA))
    assert engine.search(query="movie").total == 2
    engine.cancel("one")


@pytest.mark.parametrize("least", [1, 0])  # from the stored ranking, and from the statistics
def test_terms_left_out_make_room_for_others(engine, least):
    every = [r["term"] for r in engine.keywords.top(min_docs=least).collect()]
    assert len(every) > 3
    assert [r["term"] for r in engine.keywords.top(2, least, without=(every[0], every[2])).collect()] == [every[1], every[3]]


def test_a_term_of_most_items_is_no_single_task_s(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sync.by_term(spark.range(400).selectExpr("'hot' as term", "'body' as field", "id", "1 as tf"))
        assert rows.select(F.spark_partition_id().alias("task")).groupBy("task").count().agg(F.max("count")).first()[0] < 300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_task_for_each_slot(spark):
    assert sync.slotted(spark.range(1, 101).select("id"), 0, 100, 10).rdd.getNumPartitions() == 10


def test_a_build_deals_no_postings(spark, tmp_path, data):
    """Postings, the largest part, are counted and put in order where items are read; lists are ordered once."""
    from quarry.operators import index
    from quarry.queries import item_source

    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(item_source(spark, data))
    texts = [None, "", "a a a b", "Été ete ÉTÉ x", "!!!", "22 1 22 p1/p1", "漢字 漢字 x", "the " * 3000]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    items = spark.createDataFrame(rows, "id long, name string, body string")
    own, dealt = index.item_postings(items), index.postings(items)
    assert "Exchange" not in plan(own.sortWithinPartitions("term", "id"))
    assert sorted(own.collect()) == sorted(dealt.collect()) and own.dtypes == dealt.dtypes
    e = Engine(spark, str(tmp_path / "dealt"), hot_min_docs=1)
    seen = []
    e.runs.progress = lambda step: seen.append(step)
    e.rebuild(item_source(spark, data))
    stored = e.read("postings").withColumn("file", F.input_file_name()).collect()
    by_file = {}
    for r in stored:
        by_file.setdefault(r["file"], []).append((r["term"].encode(), r["id"]))
    assert {"postings", "terms", "ranking"} <= set(seen) and all(own == sorted(own) for own in by_file.values())
