"""The engine: one store of items, searched, ranked, updated."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Collection
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normalized_keyword, typed_words
from quarry.operators import keywords, suggest, tree
from quarry.operators.index import Index
from quarry.operators.readings import possible_words, segmented
from quarry.operators.readings import readings as readings_of
from quarry.operators.search import LISTED, Response, latest, search, text_hits, with_previews
from quarry.plans.spec import SearchSpec, latest_page
from quarry.sources.keyword_files import read_keywords, write_keywords
from quarry.streaming.store import Store
from quarry.streaming.sync import Result, Sync

#: Totals and pages that are remembered, by state and search.
KNOWN_TOTALS, KNOWN_PAGES = 200, 200
#: Searches whose hits are kept for the pages that follow.
KNOWN_HITS = 4
#: Files of the filter list's log that are kept apart, and seconds until one may be merged.
LOG_FILES, LOG_SECONDS = 64, 3600
#: Folders of rankings whose file lists are remembered.
KNOWN_PARTS = 8


class Imported(NamedTuple):
    """Terms that an import added, distinct terms that its file holds, and terms that are filtered now."""

    new: int
    accepted: int
    total: int


class Keywords:
    """Rankings and the filter list, which lies outside the versioned data and outlives rebuilds."""

    def __init__(self, engine: Engine):
        self._engine = engine
        self._filtered: tuple[set[str], set[str]] | None = None

    def filters(self) -> DataFrame:
        spark, store = self._engine.spark, self._engine.store
        if not store.files.exists("keyword_filter"):
            return spark.createDataFrame([], "term string, created_at timestamp")
        return spark.read.parquet(f"{store.root}/keyword_filter").groupBy("term").agg(F.min("created_at").alias("created_at"), F.max_by("removed", "seq").alias("gone")).where("not gone").select("term", "created_at").orderBy("term")

    def _log(self, terms: DataFrame, removed: bool) -> None:
        """One more file of the log. Changes are in the order of their times, so that two drivers need not agree on numbers."""
        rows = terms.select("term", F.current_timestamp().alias("created_at"), F.lit(removed).alias("removed"), F.lit(time.time_ns()).cast("long").alias("seq"))
        rows.coalesce(1).write.mode("append").parquet(f"{self._engine.store.root}/keyword_filter")
        self.compact()

    def compact(self) -> int:
        """Files of the log that are ``LOG_SECONDS`` old become one, if they are over ``LOG_FILES``; returns how many. Younger ones may be being read."""
        store = self._engine.store
        old = [n for n, age in store.files.children("keyword_filter").items() if n.endswith(".parquet") and age > LOG_SECONDS]
        if len(old) <= LOG_FILES:
            return 0
        log = f"{store.root}/keyword_filter"
        rows = self._engine.spark.read.parquet(*(f"{log}/{n}" for n in old)).groupBy("term")
        last = rows.agg(F.min("created_at").alias("created_at"), F.max_by("removed", "seq").alias("removed"), F.max("seq").alias("seq"))
        last.coalesce(1).write.mode("append").parquet(log)
        for name in old:
            store.files.delete(f"keyword_filter/{name}")
        return len(old)

    def add(self, terms: list[str] | DataFrame) -> int:
        """Normalised terms that were not in the list before; returns how many."""
        if not isinstance(terms, DataFrame):
            terms = self._engine.spark.createDataFrame([(t,) for t in terms], "term string")
        own = terms.select(normalized_keyword(F.col("term")).alias("term")).where("term <> ''").distinct()
        new = own.join(self.filters(), "term", "left_anti").persist()
        try:
            n = new.count()
            if n:
                self._log(new, False)
            return n
        finally:
            new.unpersist()

    def remove(self, term: str) -> None:
        self._log(self._engine.spark.createDataFrame([(term,)], "term string").select(normalized_keyword(F.col("term")).alias("term")), True)

    def load(self, path: str) -> int:
        return self.add(read_keywords(self._engine.spark, path))

    def import_terms(self, path: str) -> Imported:
        """``load``, with what the file holds and the list has afterwards; the same file once more changes nothing."""
        terms = read_keywords(self._engine.spark, path).persist()
        try:
            return Imported(self.add(terms), terms.count(), self.filters().count())
        finally:
            terms.unpersist()

    def save(self, path: str) -> None:
        write_keywords(self.filters(), path)

    def stats(self) -> DataFrame:
        return keywords.merged(self._engine.store.keyword_counts())

    def ranking(self) -> DataFrame | None:
        """The stored ranking (rank from 0, term, doc_count, occurrences; filters not applied); None if the state has come after it."""
        state = self._engine.store.manifest()
        if not state.ranking or state.ranked != state.names:
            return None
        return self._engine.part(f"ranks/{state.ranking}/terms")

    def grams(self) -> DataFrame:
        return self._engine.part(f"ranks/{self._engine.store.manifest().ranking}/grams")

    def filtered(self) -> set[str]:
        """The filter list, which people maintain by hand; remembered until it changes."""
        log = self._engine.store.files.children("keyword_filter")
        if self._filtered is None or self._filtered[0] != set(log):
            self._filtered = (set(log), {r["term"] for r in self.filters().collect()} if log else set())
        return self._filtered[1]

    def top(self, limit: int | None = None, min_docs: int | None = None, without: Collection[str] = ()) -> DataFrame:
        """The ranking, filters applied when read, so that counts are complete whatever is filtered. ``without``: terms to leave out
        besides those of the filter list, before the limit counts.

        The stored one is in order and as long as ``min_docs`` is not below the store's own: a limit reads its first rows,
        one more for each filtered term.
        """
        least = self._engine.hot_min_docs if min_docs is None else min_docs
        stored = self.ranking() if least >= self._engine.hot_min_docs else None
        if stored is None:
            gone = self.filters().select("term")
            gone = gone.unionByName(self._engine.spark.createDataFrame([(t,) for t in without], "term string")) if without else gone
            return keywords.top_keywords(self.stats(), gone, least, limit)
        gone = {*self.filtered(), *without}
        most = keywords.MAX_TERMS if limit is None else max(1, min(limit, keywords.MAX_TERMS))
        kept = stored.where((F.col("rank") < most + len(gone)) & (F.col("doc_count") >= least))
        if gone:
            kept = kept.where(~F.col("term").isin(*gone))
        return kept.orderBy("rank").limit(most).select("term", "doc_count", "occurrences")


class Engine:
    """Opens or makes a store at ``root``. ``hot_min_docs``: items that a term must be in to be ranked and suggested."""

    def __init__(self, spark: SparkSession, root: str, hot_min_docs: int = keywords.MIN_DOCS):
        self.spark = spark
        self.hot_min_docs = hot_min_docs
        self.store = Store(spark, root)
        self.runs = Sync(self.store, hot_min_docs=hot_min_docs)
        self.keywords = Keywords(self)
        self._totals: OrderedDict[Any, int] = OrderedDict()
        self._pages: OrderedDict[Any, Response] = OrderedDict()
        self._hits: OrderedDict[Any, DataFrame] = OrderedDict()
        self._parts: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def rebuild(self, source: DataFrame) -> Result:
        return self.runs.rebuild(source)

    def sync(self, source: DataFrame) -> Result:
        return self.runs.sync(source)

    def refresh(self, source: DataFrame) -> Result:
        return self.runs.refresh(source)

    def read(self, part: str) -> DataFrame:
        """A part of the state: docs, postings or files."""
        return self.store.read(part)

    def part(self, place: str) -> DataFrame:
        """A written folder, whose files are listed once."""
        return self._remembered(self._parts, place, KNOWN_PARTS, lambda: self.spark.read.parquet(f"{self.store.root}/{place}"), count=False)

    def index(self) -> Index:
        state = self.store.manifest()
        docs = self.store.read("docs", state)
        n, dl = state.totals
        corpus = self.spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(dl).cast("long").alias("total_dl"))
        return Index(docs, self.store.read("postings", state), docs.select("id", "dl"), corpus, self.store.term_rows(state))

    def _text_hits(self, spec: SearchSpec, index: Index) -> DataFrame:
        """The hits of a search, kept for the pages that follow."""
        key = (self._state(), spec.query, spec.search_in, spec.sort_by == "relevance")
        if key not in self._hits:
            self._hits[key] = text_hits(index, spec).persist()
            while len(self._hits) > KNOWN_HITS:
                self._hits.popitem(last=False)[1].unpersist()
        self._hits.move_to_end(key)
        return self._hits[key]

    def _state(self) -> tuple:
        """Changes with every commit, so what is remembered under it is never stale."""
        state = self.store.manifest()
        return state.version, state.names

    def _remembered(self, known: OrderedDict, key: Any, most: int, make: Callable[[], Any], count: bool = True) -> Any:
        if key in known:
            self.hits += count
        else:
            self.misses += count
            known[key] = make()
            while len(known) > most:
                known.popitem(last=False)
        known.move_to_end(key)
        return known[key]

    def _total(self, spec: SearchSpec, found: DataFrame) -> int:
        return self._remembered(self._totals, (self._state(), spec.without_paging()), KNOWN_TOTALS, found.count)

    def search(self, raw: SearchSpec | dict | None = None, tag: str | None = None, **more: Any) -> Response:
        """One page. Pages are remembered, whole sets are not. A search with a tag can be cancelled by it."""
        spec = SearchSpec.of(raw, **more)

        def run() -> Response:
            index = self.index()
            known = None if spec.by == "hash" else self._text_hits(spec, index)
            return search(index.docs, spec, self.store.looked_up, index, count=self._total, known=known)

        context = self.spark.sparkContext
        if tag:
            context.addJobTag(tag)
        try:
            return run() if spec.whole else self._remembered(self._pages, (self._state(), spec), KNOWN_PAGES, run)
        finally:
            if tag:
                context.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Ends the searches that run under a tag."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def latest(self, limit: Any = None, offset: Any = None) -> Response:
        n, skip = latest_page(limit, offset)
        rows = [r.asDict() for r in latest(self.read("docs"), n, skip).select(*LISTED).collect()]
        return Response(with_previews(rows, self.store.looked_up, ""), self.count(), n, skip, False, None)

    def typed(self, text: str) -> list[str]:
        """The words of a typed text: of Han characters by the stored counts, else runs of letters and digits."""
        possible = possible_words(text)
        if not possible:
            return typed_words(text)
        ranking = self.keywords.ranking()
        stats = ranking if ranking is not None else self.keywords.stats()
        known = stats.where(F.col("term").isin(*possible)).select("term", "doc_count").collect()  # stretches of one typed text
        return segmented(text, {r["term"]: r["doc_count"] for r in known})

    def readings(self, table: DataFrame) -> DataFrame:
        """Readings of the ranked words, for ``suggest``; ``table``: text and reading."""
        ranking = self.keywords.ranking()
        return readings_of(ranking if ranking is not None else keywords.ranked(self.keywords.stats(), None, self.hot_min_docs), table)

    def suggest(self, text: str, most: int = suggest.MOST, readings: DataFrame | None = None) -> list[str]:
        """Words of the ranking that the typed words match, best first.

        Candidates come from the stored n-grams and the first ranks; words on the filter list are left out, and those behind
        them move up. While the ranking is behind the state, or with readings, every ranked word is scored.
        """
        typed = self.typed(text)
        if not typed:
            return []
        stored = self.keywords.ranking() if readings is None else None
        if stored is None:
            words = keywords.ranked(self.keywords.stats(), self.keywords.filters(), self.hot_min_docs)
        else:
            gone = self.keywords.filtered()
            words = suggest.gram_candidates(stored, self.keywords.grams(), typed, suggest.FUZZY_RANKS + len(gone))
            if gone:
                ahead = sorted(r["rank"] for r in stored.where(F.col("term").isin(*gone)).select("rank").collect())  # no more than the list
                if ahead:
                    before = F.size(F.filter(F.array(*map(F.lit, ahead)), lambda x: x < F.col("rank")))
                    words = words.where(~F.col("term").isin(*gone)).withColumn("rank", F.col("rank") - before)
        return [r["term"] for r in suggest.suggestions(words, typed, most, readings).collect()]

    def count(self) -> int:
        return self.store.manifest().totals[0]

    def file_nodes(self, item: int) -> DataFrame:
        """The nodes of an item's files, as ``tree.flat_tree`` gives them."""
        own = self.store.looked_up([item])
        return tree.flat_tree(tree.file_rows((self.read("files").where("false") if own is None else own).select("id", "file_list")))

    def file_tree(self, item: int) -> list[dict] | None:
        """The same as a list in order, as a detail page shows it; None if there is no such item. A list is one cell of the source."""
        own = self.store.looked_up([item])
        if own is None or own.select("id").isEmpty():
            return None
        return [r.asDict() for r in self.file_nodes(item).orderBy("idx").collect()]

    def stats(self) -> dict[str, Any]:
        """The state, the step of a run at work (None between runs), how far each stream is, and how often what is remembered answered."""
        state, asked = self.store.manifest(), self.hits + self.misses
        own = {"step": self.runs.step, "streams": self.runs.running(), "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0}
        return own | {"version": state.version, "watermark": state.watermark, "segments": len(state.segments), "items": state.totals[0]}
