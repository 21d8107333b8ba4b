import sqlite3

import pytest

from quarry.operators import index, search
from quarry.plans.spec import SearchSpec, ordering

ROWS = [
    (1, "Alpha.Beta.Gamma.Alpha.mkv", "Alpha.Beta.Gamma.Alpha.mkv", 336, 1788, "hash" + "1".zfill(40)),
    (2, "Some.Random.Movie.2024.1080p", "Movie.mkv\nSample/sample.txt", 8589935626, 1700, "hash" + "2".zfill(40)),
    (3, "Café au lait", "été/naïve.txt", 4920119296, 1750, None),
    (4, "Alphabet.Superstars.4K", "Beta.mkv", 21474836480, 1800, "0" * 39 + "4"),
    (5, "日本語 テスト", "", 336, 1788, "ABC"),
    (6, "", "", 336, 1788, "abcd"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "id long, name string, body string, total_size long, fetched_at long, infohash string").cache()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(name, body, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into f(rowid, name, body) values (?, ?, ?)", [r[:3] for r in ROWS])
    return con


QUERIES = ["alpha", "alph", "ALPHA beta", "beta gam", "cafe", "CAFÉ", "naive", "sample", "2024 10", "日本", "mkv", "zzz", "alpha zzz"]


@pytest.mark.parametrize("text", QUERIES)
@pytest.mark.parametrize("field", [None, "name"])
def test_hits_and_scores_are_those_of_a_full_text_index(items, fts, text, field):
    terms = search.wanted(text)
    match = " AND ".join(f'"{t}"' + ("*" if p else "") for t, p in terms)
    match = f"name:({match})" if field else match
    expected = {r[0]: r[1] for r in fts.execute("select rowid, bm25(f) from f where f match ?", (match,))}
    for found in (search.scan_ranked(items, text, field), search.index_ranked(index.build(items), text, field)):
        got = {r["id"]: r["score"] for r in found.collect()}
        assert got == pytest.approx(expected, abs=1e-9)
    assert {r["id"] for r in search.index_hits(index.build(items), text, field).collect()} == set(expected)


@pytest.mark.parametrize("bounds", [(1000, 1_000_000), (0, 1_000_000), (0, 0)])
def test_rarest_first_finds_the_same(items, monkeypatch, bounds):
    monkeypatch.setattr(search, "NAMED_IDS", bounds[0])
    monkeypatch.setattr(search, "BROADCAST_IDS", bounds[1])
    built = index.build(items)
    counted = index.Index(built.docs, built.postings, built.doc_stats, built.corpus, index.term_rows(built.postings))
    for text in QUERIES:
        for field in (None, "name"):
            plain = sorted(map(tuple, search.index_hits(built, text, field).collect()))
            assert sorted(map(tuple, search.index_hits(counted, text, field).collect())) == plain


def test_nothing_to_search_for(items):
    for text in ("", "...---...", "  "):
        with pytest.raises(ValueError):
            search.search(items, {"query": text})
    with pytest.raises(ValueError):
        search.search(items, {"query": "ab", "by": "hash", "sort_by": "relevance"})


def ids(response):
    return [r["id"] for r in response.items]


def test_orders(items):
    ask = lambda **x: ids(search.search(items, {"query": "mkv"} | x))
    assert ask() == [4, 2, 1]
    assert ask(order="asc") == [1, 2, 4]
    assert ask(sort_by="totalSize") == [4, 2, 1]
    assert ask(sort_by="totalSize", order="asc") == [1, 2, 4]
    assert ask(sort_by="fetchedAt") == [4, 1, 2]
    assert ask(sort_by="fetchedAt", order="asc") == [2, 1, 4]
    assert ask(sort_by="nonsense") == [4, 2, 1]
    assert ask(min_size=337) == [4, 2]
    assert ask(max_size=336) == [1]


@pytest.mark.parametrize("sort", [None, "totalSize", "fetchedAt"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_put_together_are_the_whole(items, sort, order):
    every = items.withColumn("name", items["name"])
    spec = SearchSpec.of(query="m", sort_by=sort, order=order, by="fts")
    whole = [r["id"] for r in every.orderBy(*ordering(spec)).collect()]
    got, cursor = [], None
    while True:
        one = SearchSpec.of(spec, limit=2, cursor=cursor)
        rows = [r.asDict() for r in search.page(every, one).collect()]
        got += [r["id"] for r in rows]
        if len(rows) < 2:
            break
        cursor = search.encode_cursor(rows[-1][one.sort_column], rows[-1]["id"])
    assert got == whole
    offsets = [r["id"] for n in range(0, 6, 2) for r in search.page(every, SearchSpec.of(spec, limit=2, offset=n)).collect()]
    assert offsets == whole


def test_paging_contract(items):
    r = search.search(items, {"query": "mkv", "limit": 2})
    assert (r.total, len(r.items), r.truncated) == (3, 2, False) and r.next_cursor
    last = search.search(items, {"query": "mkv", "limit": 2, "cursor": r.next_cursor})
    assert ids(last) == [1] and last.next_cursor is None
    past = search.search(items, {"query": "mkv", "offset": 999})
    assert past.items == [] and past.total == 3
    whole = search.search(items, {"query": "mkv", "limit": "all"}, most=2)
    assert len(whole.items) == 2 and whole.truncated and whole.next_cursor is None
    with pytest.raises(ValueError):
        search.search(items, {"query": "mkv", "cursor": "%%%"})


def test_hash_look_up(items):
    find = lambda q, **x: sorted(ids(search.search(items, {"query": q, "by": "hash"} | x)))
    assert find("magnet:?xt=urn:btih:hash" + "1".zfill(40)) == [1]
    assert find("1".zfill(40)) == [1]  # stored behind ``hash``
    assert find("abc") == [5, 6]
    assert find("0" * 20) == [4]
    assert find("abc", min_size=1000) == []  # the size range holds for exact hits too


def test_latest(items):
    assert [r["id"] for r in search.latest(items, 2, 1).collect()] == [5, 4]
    assert search.latest(items, 5, 50).collect() == []


def test_previews(items, spark):
    previews = spark.createDataFrame([(2, [("Movie.mkv", 1.0), ("Sample/sample.txt", 2.0)])], "id long, preview array<struct<path:string,size:double>>")
    r = search.search(items, {"query": "sample"}, previews)
    assert [f["path"] for f in r.items[0]["preview"]] == ["Sample/sample.txt"]
    assert search.search(items, {"query": "alpha"}, previews).items[0]["preview"] == []


def test_empty_table(items):
    assert search.search(items.where("id > 99"), {"query": "a", "sort_by": "relevance"}).total == 0


def test_precision_of_lists(spark):
    from quarry.operators.compare import list_precision

    paths = spark.createDataFrame([(1, ["a/Movie.mkv", "b"]), (2, ["c"]), (3, [])], "id long, paths array<string>")
    lists = spark.createDataFrame([("movie", [1, 2, 9]), ("c", [2, 3]), ("x", [])], "query string, ids array<long>")
    assert list_precision(lists, paths).collect()[0][0] == 0.5
    assert list_precision(lists.where("query = 'x'"), paths).collect()[0][0] == 1.0


def test_tasks_grow_with_the_postings(items, spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_POSTINGS", 1)
    monkeypatch.setattr(search, "BROADCAST_IDS", 0)
    found = index.postings(items)
    own = index.Index(items, found, index.doc_stats(items), index.corpus_stats(index.doc_stats(items)), index.term_rows(found))
    rows = found.where("term = 'movie' or term like '2%'").count()
    hits = search.index_hits(own, "movie 2")
    assert rows > 1 and "REPARTITION_BY_NUM" in hits._jdf.queryExecution().executedPlan().toString()
    plain = search.index_hits(index.build(items), "movie 2")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.collect()))
    ranked = [sorted((r["id"], round(r["score"], 9)) for r in search.index_ranked(i, "movie 2").collect()) for i in (own, index.build(items))]
    assert ranked[0] == ranked[1]
