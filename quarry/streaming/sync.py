"""Building and updating a store: rebuilds, increments, streams, compaction."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quarry.operators.index import item_postings, length, term_rows
from quarry.operators.keywords import MIN_DOCS, keyword_stats, merged, ranked
from quarry.operators.suggest import grams
from quarry.sources.items import ITEM_SCHEMA, check_schema, extent, file_changes, fingerprinted, since, sized_extent, with_file_facts
from quarry.streaming.store import FORMAT, Files, Manifest, Segment, Store

#: Rows of small segments that make a compaction worth while; segments of one size class that do.
COMPACT_ROWS, FANOUT = 50_000, 4
#: Rows of a slot of files.
SLOT_ROWS = 20_000


@dataclass
class Result:
    """What a run did. ``rows``: items written; ``replaced``: stored items that they took the place of; ``span``: ids that the watermark moved over."""

    kind: str
    rows: int = 0
    span: int = 0
    skipped: bool = False
    seconds: dict[str, float] = field(default_factory=dict)
    replaced: int = 0
    #: Smallest and largest id of an appended batch.
    ids: tuple[int, int] | None = None


class Busy(RuntimeError):
    """Another run is at work on this store."""


def size_class(rows: int, fanout: int = FANOUT) -> int:
    """0 below ``fanout`` rows, one more for each factor ``fanout``."""
    out = 0
    while rows >= fanout:
        rows, out = rows // fanout, out + 1
    return out


class Progress(StreamingQueryListener):
    """What streams of this session last reported, by their id."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 (the listener's names)
        self.known.setdefault(str(event.id), {})["active"] = True

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.known.setdefault(str(p.id), {}).update(batch=p.batchId, batch_rows=p.numInputRows, rows_per_second=round(p.processedRowsPerSecond, 3), at=p.timestamp)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.known.setdefault(str(event.id), {})["at"] = event.timestamp

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.known.setdefault(str(event.id), {}).update(active=False, error=event.exception)


def slot_width(low: int, high: int, rows: int | None) -> int:
    """Ids that a slot holds: as many as share ``SLOT_ROWS`` rows where they are dense."""
    slots = max(1, -(-(rows or 0) // SLOT_ROWS))
    return max(1, -(-(high - low) // slots))


def slotted(rows: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """``rows`` with slot, those of one slot together and in order, over a task for each slot that there may be."""
    slot = F.floor((F.col("id") - F.lit(low + 1)) / F.lit(width)).cast("long")
    return rows.withColumn("slot", slot).repartition(max(1, -(-(high - low) // width)), "slot").sortWithinPartitions("slot", "id")


def by_term(found: DataFrame) -> DataFrame:
    """Postings in order. Ranges end between two ids too, so that a term which most items hold is no single task's."""
    return found.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


class Sync:
    """The runs that change a store: one at a time in this driver, and whole against those of other drivers.

    An item that is written again replaces the stored one: the new segment names, for each older one, the ids that
    no longer count there. Reads leave them out; compaction drops them for good.
    """

    def __init__(self, store: Store, progress: Callable[[str], None] | None = None, hot_min_docs: int = MIN_DOCS):
        self.store, self.progress, self.hot_min_docs = store, progress or (lambda step: None), hot_min_docs
        self._lock = threading.Lock()
        self.step: str | None = None
        self._progress: Progress | None = None
        self._written: dict[str, dict] = {}

    def _step(self, result: Result, name: str, run: Callable[[], object]) -> object:
        self.step = name
        self.progress(name)
        began = time.perf_counter()
        out = run()
        result.seconds[name] = round(result.seconds.get(name, 0.0) + time.perf_counter() - began, 3)
        return out

    def write_segment(self, rows: DataFrame, low: int, high: int, result: Result, n: int | None = None) -> Segment:
        """All parts of a segment. The source is read and its file lists are parsed once, for the files part, from
        which the other parts are made. Postings are ordered by term within each file of some items, so a look-up reads few
        pages of each and nothing is dealt by term; files lie in slots of ids, so one of an item opens one file.
        ``n``: rows, as far as they are known."""
        name = f"{high}-{uuid.uuid4().hex[:12]}"
        at = lambda part: self.store.place(name, part)
        width = slot_width(low, high, n)
        # Rows are dealt before their lists are parsed, which makes them several times as wide.
        items = fingerprinted(with_file_facts(slotted(rows, low, high, width))).withColumns({"name": F.coalesce("name", F.lit("")), "total_size": F.coalesce("total_size", F.lit(0)), "fetched_at": F.coalesce("fetched_at", F.lit(0))})
        narrow = ("id", "name", "infohash", "magnet", "total_size", "fetched_at", "file_count")
        wide = items.select(*narrow, "files", "file_list", "preview", "body", "fingerprint", "slot")
        self._step(result, "files", lambda: wide.write.partitionBy("slot").mode("overwrite").parquet(at("files")))
        files = self.store.spark.read.parquet(at("files")).drop("slot")
        texts = files.select("id", "name", "body")
        docs = files.select(*narrow, F.lower("infohash").alias("hash_key"), length().alias("dl"))
        terms = item_postings(texts).sortWithinPartitions("term", "id")
        parts = {"docs": docs.sortWithinPartitions("id"), "postings": terms, "keyword_stats": keyword_stats(texts, "name")}

        def write(part: str) -> None:
            self._step(result, part, lambda: parts[part].write.mode("overwrite").parquet(at(part)))

        with ThreadPoolExecutor(len(parts)) as pool:  # a small segment's jobs leave cores free
            list(pool.map(write, parts))
        self._step(result, "terms", lambda: self._count_terms(name))
        own = self.store.spark.read.parquet(at("docs")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        result.rows = own["n"]
        return Segment(name, low, high, own["n"], own["dl"], width)

    def _count_terms(self, segment: str) -> None:
        found = self.store.spark.read.parquet(self.store.place(segment, "postings"))
        term_rows(found).sortWithinPartitions("term").write.mode("overwrite").parquet(self.store.place(segment, "terms"))

    def _replacing(self, made: Segment, state: Manifest, result: Result, own_ids: DataFrame | None = None, targets: tuple[Segment, ...] | None = None) -> Segment:
        """``made``, with what it replaces in the state's segments written down.

        ``own_ids``: the ids that replace (by default those of ``made``); ``targets``: where (by default all segments whose ids may be among them).
        """
        targets = tuple(s for s in state.segments if s.meets(made.low, made.high)) if targets is None else targets
        made = replace(made, attempt="", gone={})
        if not targets:
            return made
        ids = self.store.spark.read.parquet(self.store.place(made.name, "docs")).select("id") if own_ids is None else own_ids
        old = None
        for s in targets:
            live = self.store.read("docs", state, (s.name,)) if s.name in state.names else self.store.spark.read.parquet(self.store.place(s.name, "docs"))
            live = live.where(F.col("id").between(made.low + 1, made.high)).select("id", "dl", "name", F.lit(s.name).alias("segment"))
            old = live if old is None else old.unionByName(live)
        attempt = uuid.uuid4().hex[:12]
        place = self.store.place(made.name, f"gone-{attempt}")
        self._step(result, "replaced", lambda: old.join(ids, "id", "left_semi").write.partitionBy("segment").parquet(place))
        # Names of segments are given, so that they are never taken for numbers.
        known = self.store.spark.read.schema("id long, dl long, name string, segment string").parquet(place)
        counted = {r["segment"]: (r["n"], r["dl"]) for r in known.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}  # one row a segment
        if not counted:
            self.store.files.delete(f"segments/{made.name}/gone-{attempt}")
            return made
        words = keyword_stats(known, "name", ("segment",))
        words.write.partitionBy("segment").parquet(self.store.place(made.name, f"gone_keywords-{attempt}"))
        for name in counted:  # a segment whose lost items say no word has no folder yet
            if not self.store.files.exists(f"segments/{made.name}/gone_keywords-{attempt}/segment={name}"):
                words.where("false").drop("segment").write.parquet(self.store.place(made.name, f"gone_keywords-{attempt}/segment={name}"))
        result.replaced = sum(n for n, _ in counted.values())
        return replace(made, attempt=attempt, gone=counted)

    def _rank(self, result: Result) -> None:
        """The ranking of the state and its n-grams, in order; left out if another writer has changed the state meanwhile."""
        state = self.store.manifest()
        if not state.segments or state.ranked == state.names and state.ranking:
            return
        name = uuid.uuid4().hex
        place = f"{self.store.root}/ranks/{name}"
        stats = merged(self.store.keyword_counts(state))

        def write() -> None:
            ranked(stats, None, self.hot_min_docs, counts=True).sortWithinPartitions("rank").write.parquet(f"{place}/terms")
            grams(self.store.spark.read.parquet(f"{place}/terms")).sortWithinPartitions("gram", "rank").write.parquet(f"{place}/grams")

        self._step(result, "ranking", write)
        self.store.commit(lambda now: replace(now, ranking=name, ranked=state.names) if now.names == state.names else None)

    def _held(self, run: Callable[[], Result], wait: bool = False) -> Result:
        if not self._lock.acquire(blocking=wait):
            raise Busy("a run is at work")
        try:
            return run()
        finally:
            self.step = None
            self._lock.release()

    def rebuild(self, source: DataFrame) -> Result:
        """Everything anew beside the old state, which stays until the new one is committed.

        What other drivers commit meanwhile stays, and replaces the rebuilt items of its ids.
        """
        check_schema(source)
        return self._held(lambda: self._rebuild(source))

    def _rebuild(self, source: DataFrame) -> Result:
        result, before = Result("rebuild"), self.store.manifest()
        ends = self._step(result, "extent", lambda: sized_extent(source))
        made = self.write_segment(since(source, None, ends[1]), ends[0] - 1, ends[1], result, ends[2]) if ends else None
        result.span = ends[1] - ends[0] + 1 if ends else 0

        def change(now: Manifest) -> Manifest:
            later = tuple(s for s in now.segments if s.name not in before.names)
            own = made
            if own and later:
                ids = self.store.read("docs", now, tuple(s.name for s in later)).select("id")
                own = self._replacing(own, now, result, ids, (own,))
            marks = [m for m in (ends[1] if ends else None, now.watermark if later else None) if m is not None]
            return Manifest(now.version + 1, FORMAT, max(marks, default=None), ((own,) if own else ()) + later, now.batches)

        self.store.commit(change)
        self._rank(result)
        self.store.clean()
        return result

    def sync(self, source: DataFrame) -> Result:
        """Rows after the watermark, up to the largest id at the start; a store of another format is rebuilt.

        While another run is at work this one is skipped. Rows up to the watermark are not read: ``refresh``
        takes over changed file lists, and rows that were deleted need a rebuild.
        """
        check_schema(source)
        try:
            return self._held(lambda: self._sync(source))
        except Busy:
            return Result("sync", skipped=True)

    def _sync(self, source: DataFrame) -> Result:
        now = self.store.manifest()
        if now.format != FORMAT or now.version == 0:
            return self._rebuild(source)
        result = Result("sync")
        ends = self._step(result, "extent", lambda: sized_extent(since(source, now.watermark)))
        if ends:
            low = now.watermark if now.watermark is not None else ends[0] - 1
            made = self.write_segment(since(source, now.watermark, ends[1]), low, ends[1], result, ends[2])
            result.span = ends[1] - low
            self._add(made, result)
            self._rank(result)
        return result

    def _add(self, made: Segment, result: Result, stream: str | None = None, batch: int = 0) -> bool:
        """Commits one more segment; False if the stream's batch is there already."""

        def change(now: Manifest) -> Manifest | None:
            if stream is not None and batch <= now.batches.get(stream, -1):
                return None
            own = self._replacing(made, now, result)
            batches = now.batches if stream is None else {**now.batches, stream: batch}
            mark = made.high if now.watermark is None else max(now.watermark, made.high)
            return replace(now, version=max(1, now.version), format=FORMAT, watermark=mark, segments=(*now.segments, own), batches=batches)

        return self.store.commit(change) is not None

    def refresh(self, source: DataFrame) -> Result:
        """Stored items whose file text in ``source`` is another one, taken over whole.

        Changes are found by fingerprints, so only ids and hashes are compared, once for all segments; the changed
        items are one more segment, which replaces them by id. Items that the store lacks are left to
        ``sync``, those that ``source`` lacks stay as they are. ``rows``: items that were changed.
        """
        check_schema(source)
        return self._held(lambda: self._refresh(source))

    def _refresh(self, source: DataFrame) -> Result:
        now = self.store.manifest()
        if now.format != FORMAT or now.version == 0:
            return self._rebuild(source)
        result = Result("refresh")
        if not now.segments:
            return result
        changed = file_changes(source.select(*ITEM_SCHEMA.fieldNames()), self.store.read("files", now)).changed.drop("fingerprint").persist()
        try:
            ends = self._step(result, "compare", lambda: extent(changed))
            if ends:
                made = self.write_segment(changed, ends[0] - 1, ends[1], result)
                self._add(made, result)
                self._rank(result)
        finally:
            changed.unpersist()
        return result

    def append(self, batch: DataFrame, batch_id: int, stream: str = "") -> Result:
        """One micro-batch of a stream, after any run that is at work; one that is committed already, before a rebuild too, is left alone.

        Items that the store holds are replaced. Of rows with one id in a batch the one fetched last counts.
        """

        def run() -> Result:
            result = Result("append")
            if batch_id <= self.store.manifest().batches.get(stream, -1):
                return Result("append", skipped=True)
            names = ITEM_SCHEMA.fieldNames()
            latest = F.max_by(F.struct(*names), F.struct("fetched_at", F.xxhash64(*names))).alias("row")
            rows = batch.groupBy("id").agg(latest).select("row.*")
            ends = result.ids = extent(batch)
            if not ends:
                self.store.commit(lambda now: replace(now, version=max(1, now.version), batches={**now.batches, stream: batch_id}))
                return result
            made = self.write_segment(rows, ends[0] - 1, ends[1], result)
            result.skipped = not self._add(made, result, stream, batch_id)
            return result

        return self._held(run, wait=True)

    def stream(self, source: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """A streaming query that appends what arrives: once over what is there, or again and again (``every``).

        Batches are known by the id that the checkpoint gives the stream, so a new checkpoint is a new stream. Segments
        of one size are merged as they come, so their number grows with the logarithm of the batches.
        """
        check_schema(source)

        if self._progress is None:
            self._progress = Progress()
            self.store.spark.streams.addListener(self._progress)

        def write(batch: DataFrame, number: int) -> None:
            stream = json.loads(Files(self.store.spark, checkpoint).read("metadata"))["id"]
            done = self.append(batch, number, stream)
            own = self._written.setdefault(stream, {"items": 0, "replaced": 0, "span": None})
            if not done.skipped:
                span = own["span"], done.ids
                own.update(items=own["items"] + done.rows, replaced=own["replaced"] + done.replaced)
                own["span"] = span[1] if span[0] is None else span[0] if span[1] is None else (min(span[0][0], span[1][0]), max(span[0][1], span[1][1]))
            while not self.compact(wait=True).skipped:
                pass

        writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()

    def running(self) -> dict[str, dict]:
        """Of each stream that this driver started: the last batch, its rows and rate, whether it goes on, and what it wrote (items, replaced, span of ids)."""
        known = self._progress.known if self._progress else {}
        return {i: known.get(i, {}) | self._written.get(i, {}) for i in {*known, *self._written}}

    @staticmethod
    def due(state: Manifest, least_rows: int = COMPACT_ROWS, fanout: int = FANOUT) -> list[Segment]:
        """The segments to merge next: ``fanout`` or more of one size class, the smallest such class first; else those
        under ``least_rows``, if there are several and they hold that many rows together."""
        classes: dict[int, list[Segment]] = {}
        for s in state.segments:
            classes.setdefault(size_class(s.rows, fanout), []).append(s)
        for _, own in sorted(classes.items()):
            if len(own) >= fanout:
                return own
        small = [s for s in state.segments if s.rows < least_rows]
        return small if len(small) > 1 and sum(s.rows for s in small) >= least_rows else []

    def compact(self, least_rows: int = COMPACT_ROWS, fanout: int = FANOUT, wait: bool = False) -> Result:
        """Merges the segments that are ``due``, without the rows that others replace."""

        def run() -> Result:
            result = Result("compact")
            while True:  # again, if another driver changed these segments meanwhile
                state = self.store.manifest()
                own = self.due(state, least_rows, fanout)
                if not own:
                    return Result("compact", skipped=True)
                if self._merge(state, own, result):
                    break
            self._rank(result)
            self.store.clean()
            return result

        return self._held(run, wait=wait)

    def _merge(self, state: Manifest, own: list[Segment], result: Result) -> bool:
        names = tuple(s.name for s in own)
        name = f"{max(s.high for s in own)}-{uuid.uuid4().hex[:12]}"
        parts = {part: self.store.read(part, state, names) for part in ("docs", "files", "postings")}
        low, high = min(s.low for s in own), max(s.high for s in own)
        width = slot_width(low, high, sum(state.live(s)[0] for s in own))
        parts = {"docs": parts["docs"].sortWithinPartitions("id"), "files": slotted(parts["files"], low, high, width), "postings": by_term(parts["postings"])}
        parts["keyword_stats"] = merged(self.store.keyword_counts(state, names))
        for part, rows in parts.items():
            writer = rows.write.mode("overwrite")
            writer = writer.partitionBy("slot") if part == "files" else writer
            self._step(result, part, lambda writer=writer, part=part: writer.parquet(self.store.place(name, part)))
        self._step(result, "terms", lambda: self._count_terms(name))
        live = [state.live(s) for s in own]
        result.rows = sum(n for n, _ in live)
        # What they replace in segments that stay is taken along.
        gone: dict[str, tuple[int, int]] = {}
        attempt = uuid.uuid4().hex[:12]
        for s in own:
            for target, (n, dl) in s.gone.items():
                if target in state.names and target not in names:
                    had = gone.get(target, (0, 0))
                    gone[target] = (had[0] + n, had[1] + dl)
        for part in ("gone", "gone_keywords"):
            for target in gone:
                places = [self.store.place(s.name, f"{part}-{s.attempt}/segment={target}") for s in own if target in s.gone]
                self.store.spark.read.parquet(*places).write.parquet(self.store.place(name, f"{part}-{attempt}/segment={target}"))
        made = Segment(name, low, high, result.rows, sum(d for _, d in live), width, attempt if gone else "", gone)

        def change(now: Manifest) -> Manifest | None:
            if not set(names) <= set(now.names) or any(set(names) & set(s.gone) for s in now.segments if s.name not in state.names):
                return None
            return replace(now, segments=tuple(s for s in now.segments if s.name not in names) + (made,))

        return self.store.commit(change) is not None
