"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 13).

Sets of word shingles (64-bit hashes) are put in one order for all texts. Two sets of sizes n and m
with 100 * intersection >= percent * union share T = percent/100 * max(n, m) shingles at least, so for
every k up to T their first n - T + k and m - T + k shingles share k at least: a longer
prefix has more rows to join, but may ask for more matches before anything is verified.

1. Equal sets are one class. Every class shows a multi-match prefix in the order of the hashes;
   classes with fewer shingles in it that any other prefix holds than it asks for have no partner
   and are left alone. Only a fifth of the shingles is shuffled for this.
2. The sets of the others are ordered by frequency, rarest first, where edits stand in front.
   Each class takes the prefix length with the least estimated cost (``chosen_level``): rows to
   join plus candidates to verify, both from the frequencies of its own shingles; the candidates of
   a prefix that asks for k matches are at most its rows by k. A pair uses the shorter of its two prefixes.
3. Star rounds: of the classes that share a prefix shingle and have no label in common yet, each is
   verified against one of them, the one most central (first round) or picked by a hash, and
   the classes that links join get one label, as long as a round still joins many. So copies of one text by the thousand
   give one verification each, not one a pair.
4. The rest is exact: pairs of different labels that share a prefix shingle are counted; those with the
   matches that their prefixes ask for, and room left behind the last match, are verified on whole sets.
5. Components of all verified links, labelled by their smallest id.

Nothing is capped. Rows of one key that may be very many (copies of one text, a shingle, a
centre, a component) are dealt over many tasks.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; a very long text is taken in slices, and only
its set is held whole; rows with a null id are linked with nothing and are their own component (null); rows
that share an id (ids are meant to be unique) are one node and get a row each; an empty table gives an empty result; only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_key, checkpoint, column, forget, spread_join
from quarry.llm.components import components
from quarry.llm.near_dedup import text_shingles
from quarry.llm.words import mixed

#: The first prefix asks for one match and one more for so many shingles of the set.
FIRST_STEP = 20
#: Verifying a candidate costs as much as joining one row for so many shingles of its set.
VERIFY_STEP = 64
#: Star rounds go on while one of so many classes that have a candidate gains a link.
GAIN = 20


def least_shared(n: int, percent: int) -> int:
    """What a set of ``n`` shares at least with any set that it links with."""
    return -(-percent * n // 100)


def first_level(n: int, percent: int) -> int:
    """Matches that the first prefix of a set asks for; never less for a larger set."""
    return min(least_shared(n, percent), 1 + n // FIRST_STEP)


def asked(n: int, percent: int) -> int:
    """Matches to be found for any link: what the smallest possible partner's prefix asks for."""
    return first_level(least_shared(n, percent), percent)


def chosen_level(frequency: np.ndarray, n: int, percent: int) -> int:
    """Matches that a set's prefix asks for, by estimated cost; 0 if no prefix has as many shared shingles as it asks for.

    ``frequency``: of its shared shingles, rising; the rest of the ``n`` stand before them and have none else.
    """
    most = least_shared(n, percent)
    if len(frequency) < most:  # so too few in every prefix
        return 0
    levels = np.arange(1, most + 1)
    held = len(frequency) - most + levels  # shared shingles in each prefix
    rows = np.cumsum(frequency - 1.0)[held - 1]
    return int(levels[np.argmin(rows + rows / levels * (n / VERIFY_STEP))])


def class_prefixes(docs: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, set_hash (null if empty) and the first prefix of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for x in part.column(1).to_pylist():
                    found = text_shingles(x, k)
                    n = len(found)
                    if not n:
                        out.append((0, None, None))
                        continue
                    both = (int(mixed(found).sum(dtype=np.uint64)), int(mixed(found ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)))
                    prefix = found[: n - least_shared(n, percent) + first_level(n, percent)]
                    out.append((n, f"{both[0]:016x}{both[1]:016x}", prefix.view(np.int64)))
                sizes, whole, prefixes = zip(*out, strict=True)
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.string()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "set_hash", "prefix"])

    rows = docs.select(column(docs, key).cast("long").alias("id"), column(docs, text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_hash string, prefix array<long>")


def whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, n and set of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [text_shingles(x, k).view(np.int64) for x in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, set array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (id, token ...) of tokens that more than one has, with df, the rows of the token."""
    df = rows.groupBy("token").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    counts = df.select("token", F.col("n_rows").alias("n"))
    return spread_join(rows, df.withColumnRenamed("n_rows", "df"), "token", "id", counts)


def _able(classes: DataFrame, percent: int) -> DataFrame:
    """The ids of the classes that may have a partner, by the first prefixes."""
    held = _shared(classes.select("id", F.explode("prefix").alias("token"))).groupBy("id").agg(F.count("*").alias("held"))
    held = held.join(classes.select("id", "n_shingles"), "id")
    held = held.withColumn("partner", F.expr(f"({percent} * n_shingles + 99) div 100"))
    want = F.least(F.expr(f"({percent} * partner + 99) div 100"), F.expr(f"1 + partner div {FIRST_STEP}"))
    return held.where(F.col("held") >= want).select("id")


def adaptive_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """One row a shingle of a class's chosen prefix that others hold too: token, id, n, shared (its shingles that others
    hold), level (matches its prefix asks for), place (from 0, in its whole set), step (the first prefix that holds it) and centre
    (the mean frequency of its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("id", "n", "shared", "level", "centre", "tokens", "places", "steps")}
            for id_, n, found in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                values = found.values
                df, token = values.field("df").to_numpy(), values.field("token").to_numpy()
                order = np.lexsort((token, df))
                df, token = df[order], token[order]
                level = chosen_level(df, n, percent)
                if not level:
                    continue
                most, alone = least_shared(n, percent), n - len(df)
                held = n - most + level - alone
                places = alone + np.arange(held)
                own = (id_, n, len(df), level, (float(df.sum()) + alone) / n, token[:held], places, np.maximum(1, places + 1 - (n - most)))
                for name, value in zip(out, own, strict=True):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    rows = _shared(sets.select("id", F.explode("set").alias("token")))
    gathered = rows.groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))  # bounded by one text's length
    gathered = gathered.join(sets.select("id", "n"), "id").select("id", "n", "shared")
    chosen = gathered.mapInArrow(run, "id long, n long, shared long, level long, centre double, tokens array<long>, places array<long>, steps array<long>")
    each = chosen.select("id", "n", "shared", "level", "centre", F.explode(F.arrays_zip("tokens", "places", "steps")).alias("t"))
    return each.select(F.col("t.tokens").alias("token"), "id", "n", "shared", "level", F.col("t.places").alias("place"), F.col("t.steps").alias("step"), "centre")


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, v) that link, on whole sets."""

    def beside(rows: DataFrame, side: str, other: str, names: tuple[str, str]) -> DataFrame:
        """``rows`` with the size and the set of one side; sets that no pair asks for are left out before they are dealt."""
        asked_for = sets.join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_semi")
        own = asked_for.select(F.col("id").alias(side), F.col("n").alias(names[0]), F.col("set").alias(names[1]))
        return spread_join(rows, own, side, other, pairs.groupBy(side).agg(F.count("*").alias("n")))

    both = beside(beside(pairs, "u", "v", ("n", "one")), "v", "u", ("m", "other"))
    return both.where(_enough(F.size(F.array_intersect("one", "other")).cast("long"), F.col("n"), F.col("m"), percent)).select("u", "v").distinct()


def _placed(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of shingles that stand under several labels, with comp, the label of the row's class, and n_rows of the shingle."""
    own = index.withColumn("comp", F.col("id")) if labels is None else index.join(labels, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
    several = own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_rows")).where("low <> high").select("token", "n_rows")
    return checkpoint(spread_join(own, several, "token", "id", several.select("token", F.col("n_rows").alias("n"))))


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id and label of the classes that links join so far: classes of one label are connected, not all that are connected have one label.

    Each label that new edges meet goes over to the smallest label beside it, then to the one that this one goes to.
    """

    def of(side: str) -> Column:
        if labels is None:
            return F.col(side)
        return F.coalesce(F.col(f"label_{side}"), F.col(side))

    near = edges
    if labels is not None:
        for side, far in (("u", "v"), ("v", "u")):
            counts = edges.groupBy(side).agg(F.count("*").alias("n"))
            near = spread_join(near, labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}")), side, far, counts, "left")
    pairs = checkpoint(near.select(of("u").alias("a"), of("v").alias("b")).where("a <> b").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down = checkpoint(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"))
    for _ in range(2):
        onward = down.select(F.col("a").alias("b"), F.col("b").alias("c"))
        down = checkpoint(spread_join(down, onward, "b", "a", down.groupBy("b").agg(F.count("*").alias("n")), "left").select("a", F.coalesce("c", "b").alias("b")))
    if labels is None:
        return down.select(F.col("a").alias("id"), F.col("b").alias("label"))
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    moved = spread_join(labels, down.select(F.col("a").alias("label"), "b"), "label", "id", counts, "left").select("id", F.coalesce("b", "label").alias("label"))
    fresh = down.select(F.col("a").alias("id"), F.col("b").alias("label")).join(labels, "id", "left_anti")
    return checkpoint(moved.unionByName(fresh))


def _star_pairs(live: DataFrame, number: int, percent: int) -> DataFrame:
    """(u, v): each class with the centre that it shares most shingles with, of those of other labels."""
    rank = F.col("centre") if number == 0 else F.xxhash64("id", F.lit(number)).cast("double")
    heads = live.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "id", "n", "shared", "comp")).alias("head"), F.count("*").alias("n"))
    met = spread_join(live, heads.select("token", "head"), "token", "id", heads.select("token", "n"))
    room = F.least("shared", "head.shared")
    near = met.where((F.col("comp") != F.col("head.comp")) & _enough(room, F.col("n"), F.col("head.n"), percent))
    often = near.groupBy("id", F.col("head.id").alias("v")).agg(F.count("*").alias("often"))
    return often.groupBy("id").agg(F.max(F.struct("often", "v")).alias("best")).select(F.col("id").alias("u"), "best.v")


def _cross_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of different labels with the matches that their prefixes ask for and room behind the last."""
    names = ("id", "n", "shared", "level", "place", "step", "comp")
    # Of two labels at least one is not the one with most rows of a shingle, so only rows of the others are met by all.
    each = live.groupBy("token", "comp").agg(F.count("*").alias("rows"))
    heads = checkpoint(each.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("n")))
    one = spread_join(live.select("token", *names), heads.select("token", "main"), "token", "id", heads.select("token", "n"))
    one = checkpoint(one)
    other = one.where("comp <> main").select("token", *(F.col(c).alias(f"{c}_") for c in names))
    met = spread_join(one, other, "token", "id", heads.select("token", "n"))
    met = met.where((F.col("comp") == F.col("main")) | (F.col("comp") < F.col("comp_")))
    level, room = F.least("level", "level_"), F.least("shared", "shared_")
    met = met.where((F.col("comp") != F.col("comp_")) & (F.col("step") <= level) & (F.col("step_") <= level) & _enough(room, F.col("n"), F.col("n_"), percent))
    # A pair may meet either way round, according to which of its labels has most rows of a shingle.
    turned = F.col("id") > F.col("id_")
    sides = {f"{c}{i}": F.when(turned, F.col(second)).otherwise(F.col(first)) for c in ("id", "n", "level", "place") for i, first, second in ((1, c, f"{c}_"), (2, f"{c}_", c))}
    pairs = met.select(*(x.alias(name) for name, x in sides.items()))
    pairs = pairs.groupBy("id1", "id2", "n1", "n2", "level1", "level2").agg(F.count("*").alias("found"), F.max("place1").alias("last1"), F.max("place2").alias("last2"))
    most = F.col("found") + F.least(F.col("n1") - 1 - F.col("last1"), F.col("n2") - 1 - F.col("last2"))
    enough = (F.col("found") >= F.least("level1", "level2")) & _enough(most, F.col("n1"), F.col("n2"), percent)
    return pairs.where(enough).select(F.col("id1").alias("u"), F.col("id2").alias("v"))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect all classes that any link connects."""
    index = checkpoint(adaptive_prefixes(sets, percent))
    edges, labels, number = None, None, 0
    while True:
        live = _placed(index, labels)
        pairs = checkpoint(_star_pairs(live, number, percent))
        new = checkpoint(_confirmed(pairs, sets, percent))
        forget(live)
        tried, gained = pairs.count(), new.count()
        forget(pairs)
        edges = new if edges is None else edges.unionByName(new)
        if gained:
            labels = _merged(labels, new)
        number += 1
        if GAIN * gained <= tried:
            break
    live = _placed(index, labels)
    pairs = checkpoint(_cross_pairs(live, percent))
    forget(live)
    rest = checkpoint(_confirmed(pairs, sets, percent))
    forget(pairs)
    forget(index)
    return edges.unionByName(rest)


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: the id, n_shingles and component_id, the smallest id that links reach."""
    every = checkpoint(class_prefixes(docs, k, percent, key, text))
    worded = every.where(F.col("set_hash").isNotNull() & F.col("id").isNotNull())
    copies = worded.groupBy("set_hash").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    dealt = checkpoint(spread_join(every, copies.select("set_hash", "least"), "set_hash", "id", copies, "left"))
    forget(every)
    named = dealt.select("id", "n_shingles", F.coalesce("least", "id").alias("class"))
    classes = dealt.where("set_hash is not null and id is not null and (least is null or least = id)").select("id", "n_shingles", "prefix")

    able = checkpoint(_able(classes, percent))
    texts = docs.select(column(docs, key).cast("long").alias("id"), column(docs, text).alias("text")).join(able, "id", "left_semi")
    sets = checkpoint(whole_sets(texts, k))
    found = components(links(sets, percent)).withColumnRenamed("id", "class")
    out = spread_join(named, found, "class", "id", named.groupBy("class").agg(F.count("*").alias("n")), "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "class")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
