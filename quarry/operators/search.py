"""Boolean search with prefixes, ranking, orders and pages.

Two ways lead to the same hits. ``index_hits`` reads the postings of the wanted terms and
gathers them by item; ``scan_hits`` tokenises the items where they are read, without a
shuffle, for a query that no index has been built for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.bm25 import idf, term_score
from quarry.functions.text import index_tokens, normalized_hash
from quarry.operators.index import FIELDS, Index
from quarry.plans.spec import MAX_RESULTS, MOST_RESULTS, SearchSpec, after_cursor, encode_cursor, ordering, query_terms, size_range, words
from quarry.sources.items import picked_preview

#: What a page shows of an item; file lists never.
LISTED = ("id", "name", "infohash", "magnet", "total_size", "fetched_at", "file_count")


def wanted(query: str) -> list[tuple[str, bool]]:
    """The query's terms, and whether each is a prefix (the last). ValueError if there is none."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query holds no letter or digit")
    return [(t, i == len(terms) - 1) for i, t in enumerate(terms)]


def _is(term: Column, want: tuple[str, bool]) -> Column:
    return term.startswith(want[0]) if want[1] else term == want[0]


def _count(tokens: Column, want: tuple[str, bool]) -> Column:
    return F.size(F.filter(tokens, lambda x: _is(x, want)))


def _fields(search_in: str | None) -> tuple[str, ...]:
    return (search_in,) if search_in else FIELDS


def _tokenised() -> Column:
    """An array of one struct, the tokens of each field, for expressions that must look at them more than once."""
    return F.array(F.struct(*(index_tokens(F.col(f)).alias(f) for f in FIELDS)))


def scan_hits(items: DataFrame, query: str, search_in: str | None = None) -> DataFrame:
    """``items`` that match, with tf_0, tf_1, ... (hits of each term in the searched fields).

    All terms are tested by one expression, so that an item is tokenised once however many there are.
    """
    wants = wanted(query)

    def found(t: Column) -> Column:
        every = F.lit(True)
        for want in wants:
            some = F.lit(False)
            for f in _fields(search_in):
                some = some | F.exists(t[f], lambda x: _is(x, want))  # noqa: B023 (called at once)
            every = every & some
        return every

    return frequencies(items.where(F.exists(_tokenised(), found)), query, search_in)


def frequencies(items: DataFrame, query: str, search_in: str | None = None) -> DataFrame:
    """All ``items`` with tf_0, tf_1, ... and dl (tokens over all fields)."""
    tokenised = items.select("*", *(index_tokens(F.col(f)).alias(f"tokens_{f}") for f in FIELDS))
    searched = [F.col(f"tokens_{f}") for f in _fields(search_in)]
    counts = {}
    for i, want in enumerate(wanted(query)):
        counts[f"tf_{i}"] = sum((_count(t, want) for t in searched), F.lit(0))
    counts["dl"] = sum((F.size(f"tokens_{f}") for f in FIELDS), F.lit(0))
    return tokenised.withColumns(counts).drop(*(f"tokens_{f}" for f in FIELDS))


def _all_found(n: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        out = out & (F.col(f"tf_{i}") > 0)
    return out


def _any(wants: list[tuple[str, bool]]) -> Column:
    some = F.lit(False)
    for want in wants:
        some = some | _is(F.col("term"), want)
    return some


#: Postings of a task that are gathered by item.
TASK_POSTINGS = 500_000


def _known_rows(index: Index, wants: list[tuple[str, bool]]) -> list[int]:
    """Postings of each wanted term, by the index's own counts."""
    sums = (F.coalesce(F.sum(F.when(_is(F.col("term"), w), F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, w in enumerate(wants))
    return list(index.terms.where(_any(wants)).agg(*sums).first())


def _dealt(found: DataFrame, rows: int) -> DataFrame:
    """Postings dealt by item, if ``rows`` are many: a task's share stays the same however many."""
    if rows <= TASK_POSTINGS:
        return found
    return found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_POSTINGS)), "id")


def _gathered(found: DataFrame, wants: list[tuple[str, bool]]) -> DataFrame:
    sums = [F.sum(F.when(_is(F.col("term"), want), F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, want in enumerate(wants)]
    return found.groupBy("id").agg(*sums).where(_all_found(len(wants)))


#: So many ids of a query's rarest term are put into the scan of its other terms; so many are broadcast to it.
NAMED_IDS, BROADCAST_IDS = 1000, 1_000_000


def index_hits(index: Index, query: str, search_in: str | None = None) -> DataFrame:
    """id, tf_0, tf_1, ... of the items that match, from postings, gathered by id.

    If the index knows how many rows its terms have, the rarest term is read first and its items cut the postings of the
    others before these are dealt: by value where they are few, by a broadcast where the known number of rows bounds it.
    """
    wants = wanted(query)
    found = index.postings.where(F.col("field").isin(*_fields(search_in)))
    every = found.where(_any(wants))
    if index.terms is None:
        return _gathered(every, wants)
    counts = _known_rows(index, wants)
    rows, rarest = min(zip(counts, wants, strict=True))
    if rows > BROADCAST_IDS or len(wants) == 1:
        return _gathered(_dealt(every, sum(counts)), wants)
    own = found.where(_is(F.col("term"), rarest)).select("id").distinct()
    if rows > NAMED_IDS:
        return _gathered(every.join(F.broadcast(own), "id", "left_semi"), wants)  # at most ``rows`` rows
    return _gathered(every.where(F.col("id").isin(*(r["id"] for r in own.collect()))), wants)


def ranked(hits: DataFrame, totals: DataFrame, n_terms: int) -> DataFrame:
    """``hits`` (tf_i and dl) with score. ``totals``: one row of n_docs, total_dl, n_0, n_1, ..."""
    both = hits.crossJoin(F.broadcast(totals))  # one row
    mean = F.col("total_dl") / F.col("n_docs")
    score = sum((term_score(F.col(f"tf_{i}"), idf(F.col("n_docs"), F.col(f"n_{i}")), F.col("dl"), mean) for i in range(n_terms)), F.lit(0.0))
    return both.withColumn("score", -score).drop("n_docs", "total_dl", *(f"n_{i}" for i in range(n_terms)))


def scan_ranked(items: DataFrame, query: str, search_in: str | None = None) -> DataFrame:
    """Matching ``items`` with score, from two scans that each tokenise an item once: one for the totals, one for the hits."""
    n = len(wanted(query))
    counted = frequencies(items, query, search_in)
    totals = counted.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_dl"), *(F.count(F.when(F.col(f"tf_{i}") > 0, 1)).alias(f"n_{i}") for i in range(n)))
    return ranked(scan_hits(items, query, search_in), totals, n)


def index_ranked(index: Index, query: str, search_in: str | None = None) -> DataFrame:
    """id, tf_i, dl and score of the items that match, from the index alone."""
    wants = wanted(query)
    found = index.postings.where(F.col("field").isin(*_fields(search_in)))
    sums = [F.sum(F.when(_is(F.col("term"), want), F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, want in enumerate(wants)]
    own = found.where(_any(wants))
    by_item = (own if index.terms is None else _dealt(own, sum(_known_rows(index, wants)))).groupBy("id").agg(*sums)
    found_by = by_item.agg(*(F.count(F.when(F.col(f"tf_{i}") > 0, 1)).alias(f"n_{i}") for i in range(len(wants))))
    corpus = index.corpus.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_dl").alias("total_dl"))
    hits = by_item.where(_all_found(len(wants))).join(index.doc_stats, "id")
    return ranked(hits, corpus.crossJoin(found_by), len(wants))


def hash_hits(items: DataFrame, text: str, column: str = "infohash") -> DataFrame:
    """Items whose hash is the text's, is that behind ``hash``, or begins with it. A stored ``hash_key`` (lower case) lets the test reach the scan."""
    spark = items.sparkSession
    own = spark.range(1).select(normalized_hash(F.lit(text)).alias("h")).first()[0]
    if not own:
        raise ValueError("the query holds no hash")
    low = F.col("hash_key") if "hash_key" in items.columns else F.lower(F.col(column))
    return items.where((low == own) | (low == "hash" + own) | low.startswith(own))


def text_hits(index: Index, spec: SearchSpec) -> DataFrame:
    """id, and score if the spec sorts by relevance, of the items whose indexed texts match; sizes are not looked at."""
    by_score = spec.sort_by == "relevance"
    hits = index_ranked(index, spec.query, spec.search_in) if by_score else index_hits(index, spec.query, spec.search_in)
    return hits.select("id", *(["score"] if by_score else []))


def matching(items: DataFrame, spec: SearchSpec, index: Index | None = None, paged: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """All items that a spec matches, sizes included, with score if it sorts by relevance.

    ``paged``: only those after the spec's cursor. ``hits``: the spec's ``text_hits``, if they are known. Ranges and cursors are tested before texts
    are looked at; only a ranking's totals need every item.
    """
    near = size_range(spec)
    past = after_cursor(spec) if paged else None
    if past is not None:
        near = near & past
    if spec.by == "hash":
        if spec.sort_by == "relevance":
            raise ValueError("hash look-ups have no relevance")
        return hash_hits(items.where(near), spec.query)
    by_score = spec.sort_by == "relevance"
    if index is None:
        if by_score:
            return scan_ranked(items, spec.query, spec.search_in).where(near)
        return scan_hits(items.where(near), spec.query, spec.search_in)
    return items.where(near).join(text_hits(index, spec) if hits is None else hits, "id")


def whole_set_cap(most: int | None = None) -> int:
    """Rows that a whole-set fetch gives: 2000 unless set; 20000 if set to 0 or less."""
    return MAX_RESULTS if most is None else MOST_RESULTS if most <= 0 else min(most, MOST_RESULTS)


def page(found: DataFrame, spec: SearchSpec, most: int | None = None) -> DataFrame:
    """The rows of a spec's page, in order. Sorting and cutting is one top-k, before anything is joined."""
    order = ordering(spec)
    if spec.whole:
        return found.orderBy(*order).limit(whole_set_cap(most) + 1)
    past = after_cursor(spec)
    if past is not None:
        return found.where(past).orderBy(*order).limit(spec.limit)
    return found.orderBy(*order).offset(spec.offset).limit(spec.limit)


#: Rows of id and preview (and more), or what gives those of some ids; None if there is none of them.
Previews = DataFrame | Callable[[list[int]], DataFrame | None]


def with_previews(rows: list[dict], previews: Previews, query: str) -> list[dict]:
    """The rows of a page with the preview of each; without a stored one, an empty list. Only the page's ids are looked up."""
    found = {}
    for at in range(0, len(rows), LOOKED_UP):
        ids = [r["id"] for r in rows[at : at + LOOKED_UP]]
        own = previews(ids) if callable(previews) else previews.where(F.col("id").isin(*ids))
        if own is not None:
            found |= {r["id"]: r["preview"] for r in own.select("id", picked_preview(F.col("preview"), words(query)).alias("preview")).collect()}
    return [r | {"preview": [f.asDict() for f in found.get(r["id"]) or []]} for r in rows]


#: Ids of a page that one look-up names.
LOOKED_UP = 2000


@dataclass(frozen=True)
class Response:
    """One page: rows (dicts), total, and how to go on."""

    items: list[dict]
    total: int
    limit: int
    offset: int
    truncated: bool
    next_cursor: str | None


def search(
    items: DataFrame,
    raw: SearchSpec | dict,
    previews: Previews | None = None,
    index: Index | None = None,
    most: int | None = None,
    count: Callable[[SearchSpec, DataFrame], int] | None = None,
    known: DataFrame | None = None,
) -> Response:
    """The page that a search asks for. ``count`` may answer for totals that are known, ``known`` is the spec's ``text_hits`` if they are kept.

    Hits of an index are found once, for the total and for the page.
    """
    spec = SearchSpec.of(raw)
    if index is None or spec.by == "hash":
        return _page_of(items, spec, previews, index, None, most, count)
    if known is not None:
        return _page_of(items, spec, previews, index, known, most, count)
    hits = text_hits(index, spec).persist()
    try:
        return _page_of(items, spec, previews, index, hits, most, count)
    finally:
        hits.unpersist()


def _page_of(
    items: DataFrame,
    spec: SearchSpec,
    previews: Previews | None,
    index: Index | None,
    hits: DataFrame | None,
    most: int | None,
    count: Callable[[SearchSpec, DataFrame], int] | None,
) -> Response:
    """A page from known hits. Without a size range, hits give the total, and their own columns' orders cut before items are joined."""
    found = matching(items, spec, index, hits=hits)
    bare = hits is not None and spec.min_size is None and spec.max_size is None
    counted = hits if bare else found
    total = count(spec, counted) if count else counted.count()
    if bare and spec.sort_column in hits.columns:
        top = items.join(page(hits, spec, most), "id")
    else:
        top = page(matching(items, spec, index, paged=True, hits=hits) if spec.cursor else found, spec, most)
    listed = [c for c in LISTED if c in found.columns] + (["score"] if "score" in found.columns else [])
    rows = [r.asDict(recursive=True) for r in top.select(*listed).orderBy(*ordering(spec)).collect()]  # one page
    if previews is not None:
        rows = with_previews(rows, previews, "" if spec.by == "hash" else spec.query)
    cap = whole_set_cap(most)
    truncated = spec.whole and len(rows) > cap
    rows = rows[:cap] if truncated else rows
    going = not spec.whole and len(rows) == spec.limit and spec.keyset
    cursor = encode_cursor(rows[-1][spec.sort_column], rows[-1]["id"]) if going else None
    return Response(rows, total, spec.limit, spec.offset, truncated, cursor)


def latest(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The newest items by id."""
    return items.orderBy(F.desc("id")).offset(offset).limit(limit)
