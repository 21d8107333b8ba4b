from oracle import same
from quarry import queries
from quarry.operators import compare, keywords, suggest


def stats_of(spark, names):
    return keywords.keyword_stats(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string"))


def test_what_counts(spark):
    got = {r["term"]: (r["doc_count"], r["occurrences"]) for r in stats_of(spark, ["A Big big dog 2024", "big x264 7", None, "", "日本 é"]).collect()}
    assert got == {"big": (2, 3), "dog": (1, 1), "x264": (1, 1), "日本": (1, 1)}


def test_merging_parts_is_the_whole(spark):
    names = ["one two", "two three three", "one", "three two one"]
    parts = keywords.merged(stats_of(spark, names[:2]), stats_of(spark, names[2:]))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, stats_of(spark, names).collect()))


def test_ranking_and_filters(spark):
    stats = spark.createDataFrame([("bb", 60, 70), ("aa", 60, 70), ("cc", 60, 90), ("dd", 49, 99), ("ee", 70, 70)], "term string, doc_count long, occurrences long")
    assert [r["term"] for r in keywords.top_keywords(stats).collect()] == ["ee", "cc", "aa", "bb"]
    gone = spark.createDataFrame([("cc",), ("ee",), ("ee",)], "term string")
    assert [r["term"] for r in keywords.top_keywords(stats, gone, limit=1).collect()] == ["aa"]


def test_noise(spark):
    words = {"mkv": "file format", "1080p": "resolution", "1920x1080": "resolution", "4K": "resolution", "x265": "codec or source tag", "www": "web or path", "tr": "web or path", "de": "language or region", "the": "stop word", "movie": None}
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r[0]: r[1] for r in df.select("term", keywords.noise_class(df["term"])).collect()} == words


def test_candidates(spark):
    stats = spark.createDataFrame([("house", 60, 60), ("rare", 3, 3), ("movie", 99, 99), ("fr", 2, 2), ("gone", 80, 80), ("日本", 90, 90)], "term string, doc_count long, occurrences long")
    dictionary = spark.createDataFrame([("House",), ("rare",), ("movie",), ("gone",)], "term string")
    found = keywords.filter_candidates(stats, spark.createDataFrame([("gone",)], "term string"), dictionary)
    assert {r["term"]: r["reason"] for r in found.collect()} == {"house": "dictionary word", "fr": "language code"}


def test_suggestions(spark):
    words = [("movie", 0), ("movies", 1), ("home movie", 2), ("mobie", 3), ("dyna", 4), ("电影", 5), ("女神", 6), ("moviemovie", 7)]
    df = spark.createDataFrame(words, "term string, rank int")
    got = {r["term"]: r["score"] for r in suggest.suggestion_scores(df, ["movie"]).collect()}
    assert got == {"movie": 500, "movies": 300, "home movie": 150, "mobie": 40, "moviemovie": 300}
    readings = spark.createDataFrame([("电影", "dianying", "dy"), ("女神", "nvshen", "ns")], "term string, full string, initials string")
    top = [r["term"] for r in suggest.suggestions(df, ["dy"], readings=readings).collect()]
    assert top == ["dyna", "电影"]
    assert {r["term"]: r["score"] for r in suggest.suggestion_scores(df, ["nushen"], readings).collect()} == {"女神": 270}
    late = df.withColumn("rank", df["rank"] + 3000)
    assert "mobie" not in {r["term"] for r in suggest.suggestion_scores(late, ["movie"]).collect()}


def test_every_term_is_ranked(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MAX_TERMS", 3)
    rows = [("tionè", 9, 9), ("thion", 9, 12), ("a", 4, 4), ("ab", 4, 4), ("aé", 4, 4), ("日本", 4, 4), ("abc", 4, 5), ("rare", 2, 9)]
    stats = spark.createDataFrame(rows, "term string, doc_count long, occurrences long")
    got = {r["term"]: r["rank"] for r in keywords.ranked(stats, min_docs=3).collect()}
    whole = sorted((r for r in rows if r[1] >= 3), key=lambda r: (-r[1], -r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(whole)}
    gone = keywords.ranked(stats, spark.createDataFrame([("thion",)], "term string"), 3)
    assert {r["term"]: r["rank"] for r in gone.collect()}["tionè"] == 0


def test_suggestions_hold_terms_that_are_not_ascii(spark, data):
    every = {r["term"] for r in queries.suggest_scores(spark, data).collect()}
    assert any(t.isascii() for t in every) and any(not t.isascii() for t in every)


def test_agreement(spark):
    a = spark.createDataFrame([("q", [1, 2, 3]), ("r", []), ("s", [4])], "query string, ids array<long>")
    b = spark.createDataFrame([("q", [1, 3, 4]), ("r", []), ("s", [])], "query string, ids array<long>")
    got = {r["query"]: (r["jaccard"], r["same_top"]) for r in compare.list_agreement(a, b).collect()}
    assert got == {"q": (0.5, True), "r": (1.0, True), "s": (0.0, False)}


def test_addresses():
    yes = [("127.0.0.1", "127.0.0.1"), ("::ffff:10.0.0.7", "10.0.0.0/8"), ("fe80::1%eth0", "fe80::/10"), ("192.168.1.9", "192.168.1.0/24"), ("[::1]", "::1")]
    no = [("10.0.0.1", "11.0.0.0/8"), ("x", "10.0.0.0/8"), ("10.0.0.1", "10.0.0.0/40"), ("::1", "127.0.0.1"), ("", "0.0.0.0/0")]
    assert all(compare.address_matches(*x) for x in yes)
    assert not any(compare.address_matches(*x) for x in no)


def test_grams_are_runs_of_characters(spark):
    words = spark.createDataFrame([("c12", 0), ("Aé", 1)], "term string, rank int")
    found = {}
    for r in suggest.grams(words).collect():
        found.setdefault(r["term"], []).append(r["gram"])
    assert {t: sorted(g) for t, g in found.items()} == {"c12": sorted(["c", "1", "2", "c1", "12", "c12"]), "Aé": sorted(["a", "é", "aé"])}
    # A word behind the first ranks is found by what it holds.
    assert [r["term"] for r in suggest.gram_candidates(words, suggest.grams(words), ["c12"], 0).collect()] == ["c12"]


def test_ranks_have_no_bound(spark, data, monkeypatch):
    monkeypatch.setattr(keywords, "MAX_TERMS", 3)
    same(queries.hot_keyword_ranks(spark, data), queries.ORACLES["hot_keyword_ranks"], data)
