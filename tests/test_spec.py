import pytest

from quarry.plans.spec import SearchSpec, decode_cursor, encode_cursor, folded, latest_page, page_limit, query_terms, size_bound, whole_number, words


@pytest.mark.parametrize(
    "given, limit",
    [(None, 20), ("abc", 20), (0, 20), (-5, 20), ("-1", 20), (-1, -1), ("all", -1), (" ALL ", -1), (99999, 200), ("50", 50), (7.9, 7), (0.5, 1), (float("nan"), 20), ("", 20), ([], 20)],
)
def test_limits(given, limit):
    assert page_limit(given) == limit


def test_normalising_twice_changes_nothing():
    for raw in ({"query": " a b ", "sort_by": "totalSize", "order": "ASC", "limit": "all", "min_size": "5", "max_size": ""}, {"query": ["x", "y"], "by": "hash", "offset": "-3", "cursor": "c" * 257}, {}):
        once = SearchSpec.of(raw)
        assert SearchSpec.of(once) == once


def test_parameters():
    spec = SearchSpec.of(query=["one", "two"], sort_by="id; drop", order="sideways", by="x", search_in="files", offset="999", min_size=-1)
    assert (spec.query, spec.sort_by, spec.order, spec.by, spec.search_in, spec.offset, spec.min_size) == ("one", None, "desc", "fts", None, 999, None)
    assert SearchSpec.of(query=5).query == ""


def test_numbers():
    assert whole_number("12.7", 1, 0, 10) == 10
    assert whole_number("x", 3, 0, 10) == 3
    assert [size_bound(x) for x in ("", None, "10", -1, "inf", 0)] == [None, None, 10.0, None, None, 0.0]
    assert latest_page() == (30, 0)
    assert latest_page("999", "-2") == (200, 0)
    assert latest_page("all") == (30, 0)


def test_cursors():
    assert decode_cursor(encode_cursor(12.5, 7)) == (12.5, 7)
    for bad in ("", "x", "e30", encode_cursor("v", 1), "!!!"):
        with pytest.raises(ValueError):
            decode_cursor(bad)


@pytest.mark.parametrize(
    "text, terms",
    [
        ("britney AND OR NOT", ["britney", "and", "or", "not"]),
        ('"unbalanced', ["unbalanced"]),
        ("a OR 1=1", ["a", "or", "1", "1"]),
        ("NEAR(x y)", ["near", "x", "y"]),
        ("foo:bar", ["foo", "bar"]),
        ("test*^~-", ["test"]),
        ("...---...", []),
        ("  ", []),
        (None, []),
        ("Café ÉtÉ", ["cafe", "ete"]),
        ("日本語 テスト", ["日本語", "テスト"]),
    ],
)
def test_query_terms(text, terms):
    assert query_terms(text) == terms


def test_words_and_folding():
    assert words("One TWO one_two") == ["one", "two"]
    assert folded("ÀÉÎ ß ﬁ Ǡ ς") == "aei ß ﬁ ǡ σ"
