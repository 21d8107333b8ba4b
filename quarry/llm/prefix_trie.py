"""Conversation prefix trie (operator 11): which conversations share their first turns, and what that saves.

A node is a sequence of first turns that some conversation has; its owner is the smallest conversation
with it. Owners of deeper nodes on one conversation's path can only change towards the conversation
itself, so every conversation owns a chain: its nodes from a first owned depth to its end.

1. A turn is its MD5 over role and text; the digest of a prefix is two 64-bit XOR sums over (turn, place),
   so prefixes of a long conversation are made block by block, in many tasks.
2. Minima: digest, smallest conversation and number of conversations of every prefix that several have.
   Prefixes of one conversation are its own and need no row.
3. Each conversation's first owned depth is found by binary search: every round joins the prefixes of
   the depths asked for, in one batch, with the minima. Depths beyond the deepest shared prefix are not searched.
4. A chain hangs on the node before its first one. Leaves and saved words of whole chains are added up over the
   chains below, in rounds that double the distance; then each node gets what hangs on its
   own chain from it to the end, from sums of blocks of depths.
5. The numbers of the conversations that end at a node are hashed in order: joined to texts by stretches of numbers
   first, which one task then hashes one after another.

Rows of one key that may be very many (a conversation, a common first turn, a chain that many hang on) are
dealt over many tasks: order and prefixes by blocks, joins by salts, sums partly before the shuffle.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then by role and text through
the MD5 of both; turns that share a number in one conversation are ordered by that MD5; repeated rows are turns of their own; rows with a null
conversation number belong to no conversation and are left out; a conversation without turns left is a member of the root; an empty
table has no node; only the four columns are read, so other columns cannot clash; texts of any length are only hashed
and counted where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import by_key, checkpoint, column, forget, hot_keys, spread_join

WORD = r"[^\x20\x09-\x0D]+"
#: Turns from which a conversation is dealt over many tasks; a turn is a narrow row here.
LONG = 10_000
#: Depths that one block of a chain holds; blocks of turns that a very long conversation is cut into.
BLOCK, CUTS = 512, 255
#: Numbers that one stretch of a node's ends holds where they are dense.
STRETCH = 4096


def _one(df: DataFrame) -> DataFrame:
    return F.broadcast(df)  # a single row


def turn_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), digest (of role and text) and words of every turn."""
    said = F.coalesce(column(rows, text), F.lit(""))
    who = F.coalesce(column(rows, role), F.lit(""))
    whole = F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)
    words = F.regexp_count(said, F.lit(WORD)).cast("long")
    narrow = rows.select(column(rows, conv).cast("long").alias("conv"), column(rows, turn).cast("long").alias("turn"), F.md5(whole).alias("digest"), words.alias("words"))
    narrow = checkpoint(narrow.where("conv is not null"))
    # Very long conversations are cut into blocks by shares of their turns; there are fewer of them than a broadcast can hold.
    large = hot_keys(narrow.groupBy("conv").agg(F.count("*").alias("n")), "conv", LONG)
    cut = narrow.withColumn("block", F.lit(0))
    if large is not None:
        shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
        cuts = narrow.join(F.broadcast(large), "conv").groupBy("conv").agg(F.percentile_approx("turn", shares, 10_000).alias("cuts"))
        before = F.size(F.filter("cuts", lambda x: x < F.col("turn")))
        block = F.when(F.col("cuts").isNotNull() & F.col("turn").isNotNull(), before).otherwise(0)
        cut = narrow.join(F.broadcast(cuts), "conv", "left").withColumn("block", block).drop("cuts")
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = cut.withColumn("own", F.row_number().over(inside))
    sizes = cut.groupBy("conv", "block").agg(F.count("*").alias("n"))
    ahead = sizes.select("conv", "block", (F.sum("n").over(Window.partitionBy("conv").orderBy("block")) - F.col("n")).alias("ahead"))
    return placed.join(ahead, ["conv", "block"]).select("conv", (F.col("ahead") + F.col("own")).alias("place"), "digest", "words")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation whole, as (conv, length) and turns (conv, depth, digest, words)."""
    return turns.groupBy("conv").agg(F.max("place").alias("length")), turns.withColumnRenamed("place", "depth")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations that the audit is run on, as (conv, length) and turns (conv, depth, digest, words).

    Conversation c starts with the first h turns of conversation c - c % every, h = crc32(c) % most, and goes on with its own
    after its first h.
    """
    sizes = turns.groupBy("conv").agg(F.max("place").alias("own"))
    head = (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    convs = checkpoint(sizes.select("conv", "own", head, (F.col("conv") - F.col("conv") % every).alias("first")))
    heads = turns.where(F.col("place") < most).select(F.col("conv").alias("first"), "place", "digest", "words")
    lent = convs.join(heads, "first").where("place <= h").select("conv", F.col("place").alias("depth"), "digest", "words")
    taken = sizes.select(F.col("conv").alias("first"), F.col("own").alias("there"))
    convs = checkpoint(convs.join(taken, "first", "left").select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("got"), "own"))
    kept = spread_join(turns, convs.select("conv", "h", "got"), "conv", "place", convs.select("conv", F.col("own").alias("n")), heavy=LONG)
    kept = kept.where("place > h").select("conv", (F.col("got") + F.col("place") - F.col("h")).alias("depth"), "digest", "words")
    lengths = convs.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, kept.unionByName(lent)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, words of the last turn, and p and q, which name the sequence of turns up to it."""
    cut = turns.select("conv", "depth", ((F.col("depth") - 1) / BLOCK).cast("long").alias("block"), "words", F.xxhash64("digest", "depth").alias("p"), F.xxhash64(F.lit("second"), "depth", "digest").alias("q"))
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    sums = cut.groupBy("conv", "block").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv", "block", *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(f"{x}_ahead") for x in ("p", "q")))
    own = cut.select("conv", "block", "depth", "words", *(F.bit_xor(x).over(inside).alias(x) for x in ("p", "q")))
    return own.join(ahead, ["conv", "block"]).select("conv", "depth", "words", *(F.col(x).bitwiseXOR(F.col(f"{x}_ahead")).alias(x) for x in ("p", "q")))


NODE = ["depth", "p", "q"]


def shared_prefixes(paths: DataFrame) -> DataFrame:
    """The minima: depth, p, q, owner and n_convs of every prefix that several conversations have."""
    return paths.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1")


def _owners(asked: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """``asked`` (conv, depth, more) with owner, the smallest conversation with that prefix."""
    found = asked.join(paths.select("conv", *NODE), ["conv", "depth"]).withColumn("node", F.struct("depth", "p", "q"))
    known = minima.select(F.struct("depth", "p", "q").alias("node"), "owner", "n_convs")
    out = spread_join(found, known.select("node", "owner"), "node", "conv", known.select("node", F.col("n_convs").alias("n")), "left")
    return out.withColumn("owner", F.coalesce("owner", "conv")).drop("node", "p", "q")


def first_owned(lengths: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """conv, length and first, the first depth from 1 on that the conversation owns; length + 1 if none."""
    deepest = minima.agg(F.max("depth")).first()[0] or 0
    # low: owned at no depth up to it; high: owned at it and beyond, or past the end.
    state = lengths.select("conv", "length", F.lit(0).cast("long").alias("low"), F.least(F.col("length"), F.lit(deepest)).cast("long").alias("high"))
    state = checkpoint(state.withColumn("high", F.col("high") + 1))
    done = state.where("high - low <= 1")
    while True:
        going = state.where("high - low > 1")
        if going.isEmpty():
            break
        asked = _owners(going.withColumn("depth", F.expr("(low + high) div 2")), paths, minima)
        own = F.col("owner") == F.col("conv")
        after = checkpoint(asked.select("conv", "length", F.when(own, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high")))
        done = done.unionByName(after.where("high - low <= 1"))
        state = after
    return done.select("conv", "length", F.col("high").alias("first"))


def chains(owned: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """conv, length, first, and parent, the owner of the node that the chain hangs on (null: the root)."""
    hung = _owners(owned.where("first > 1").select("conv", (F.col("first") - 1).alias("depth")), paths, minima)
    return owned.join(hung.select("conv", F.col("owner").alias("parent")), "conv", "left")


def _totals(own: DataFrame) -> DataFrame:
    """conv, leaves and saved added up over each chain and all chains that hang on it, directly or not.

    ``own``: conv, parent, leaves, saved. After round i a chain has the sums of those less than 2^i below it.
    """
    state = checkpoint(own.select("conv", F.col("parent").alias("above"), "leaves", "saved"))
    while True:
        hung = state.where("above is not null")
        if hung.isEmpty():
            return state.select("conv", "leaves", "saved")
        more = checkpoint(hung.groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n")))
        ups = more.select("above", "n").join(state.select(F.col("conv").alias("above"), F.col("above").alias("up")), "above")
        # Chains under a top chain are done moving up; only the others need their parent's parent.
        moved = spread_join(hung.select("conv", "above"), ups.where("up is not null").select("above", "up"), "above", "conv", ups.select("above", "n"))
        added = state.join(more.select(F.col("above").alias("conv"), "more_leaves", "more_saved"), "conv", "left")
        summed = added.select("conv", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        after = checkpoint(summed.join(moved.select("conv", F.col("up").alias("above")), "conv", "left"))
        forget(state)
        forget(more)
        state = after


def _suffix_sums(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``nodes`` (conv, depth, ...) with each of the columns summed from the node to the end of its chain."""
    cut = nodes.withColumn("block", (F.col("depth") / BLOCK).cast("long"))
    sums = cut.groupBy("conv", "block").agg(*(F.sum(x).alias(x) for x in names))
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select("conv", "block", *(F.coalesce(F.sum(x).over(later), F.lit(0)).alias(f"{x}_after") for x in names))
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [c for c in nodes.columns if c not in names]
    own = cut.select(*kept, "block", *(F.sum(x).over(inside).alias(x) for x in names)).join(after, ["conv", "block"])
    return own.select(*kept, *((F.col(x) + F.col(f"{x}_after")).alias(x) for x in names))


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv, depth and ends_sha256 of nodes (conv, depth) at which conversations (end) end: hex SHA-256 of their numbers in order, with commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            for conv, depth, said in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (conv, depth) != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(said.encode())
            if len(out) > 10_000:
                yield made(out)
                out = []
        if last is not None:
            out.append((*last, state.hexdigest()))
        yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        convs, depths, digests = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.string())], ["conv", "depth", "ends_sha256"])

    spread = ends.agg(F.min("end").cast("double").alias("low"), F.max("end").cast("double").alias("high"), F.count("*").alias("n"))
    width = spread.select(F.greatest(F.lit(STRETCH), ((F.col("high") - F.col("low")) / F.col("n") * STRETCH).cast("long")).cast("long").alias("width"))
    dealt = ends.crossJoin(_one(width)).withColumn("stretch", F.floor(F.col("end") / F.col("width")))
    said = F.array_join(F.transform(F.sort_array(F.collect_list("end")), lambda x: x.cast("string")), ",")
    stretches = dealt.groupBy("conv", "depth", "stretch").agg(said.alias("said"))
    ordered = by_key(stretches, "conv", "depth").sortWithinPartitions("conv", "depth", "stretch").select("conv", "depth", "said")
    return ordered.mapInArrow(run, "conv long, depth long, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv, length) with turns (conv, depth from 1, digest, words)."""
    lengths = checkpoint(lengths)
    paths = checkpoint(prefixes(turns))
    minima = checkpoint(shared_prefixes(paths))
    owned = checkpoint(first_owned(lengths, paths, minima))
    hung = checkpoint(chains(owned, paths, minima))
    real = hung.where("first <= length")

    sizes = real.select("conv", F.col("length").alias("n"))
    nodes = spread_join(paths, real.select("conv", "first", "length", "parent"), "conv", "depth", sizes, heavy=LONG).where("depth >= first")
    known = minima.select(*NODE, "n_convs")
    nodes = nodes.join(known, NODE, "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1)))
    nodes = checkpoint(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))

    # What hangs on a node: chains with nodes of their own are children; the others only end there.
    children = real.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    forks = children.join(real.select("conv", "length"), "conv")
    saved = nodes.groupBy("conv").agg(F.sum("saved").alias("saved"))
    grown = forks.where("depth = length").select("conv", F.lit(True).alias("grown"))
    own = real.join(saved, "conv").join(grown, "conv", "left").select("conv", "parent", F.when(F.col("grown"), 0).otherwise(1).cast("long").alias("leaves"), "saved")
    totals = checkpoint(_totals(own))
    tops = real.join(totals, "conv")
    below = tops.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(
        F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved")
    )
    zero = F.lit(0)
    at = nodes.join(below, ["conv", "depth"], "left")
    going = (F.col("depth") < F.col("length")).cast("long")
    at = at.select("conv", "depth", "first", "parent", "n_convs", (going + F.coalesce("hung", zero)).alias("n_children"), (F.coalesce("hung_leaves", zero) + F.when((going == 0) & F.col("hung").isNull(), 1).otherwise(0)).alias("n_leaves"), (F.col("saved") + F.coalesce("hung_saved", zero)).alias("saved_tokens"))
    summed = _suffix_sums(at, ("n_leaves", "saved_tokens"))

    top = _one(lengths.agg(F.min("conv").alias("top")))
    below_root = F.when(F.col("first") > 1, F.col("parent"))
    body = summed.crossJoin(top).select("conv", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.coalesce(below_root, "top")).alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    of_tops = tops.where("parent is null").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    root = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(_one(of_tops))
    root = root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")

    where = F.when(F.col("first") <= F.col("length"), F.col("conv")).otherwise(F.when(F.col("length") > 0, F.col("parent")))
    ends = hung.crossJoin(top).select(F.coalesce(where, "top").alias("conv"), F.col("length").alias("depth"), F.col("conv").alias("end"))
    every = body.unionByName(root).join(ends_digests(ends), ["conv", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [F.col(x).cast("long").alias(y) for x, y in (("conv", "conv_id"), ("depth", "depth"), ("parent", "parent_conv_id"), ("n_convs", "n_convs"), ("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved_tokens", "saved_tokens"))]
    return every.select(*columns, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
