"""File lists as trees: flat nodes, rolled-up sizes, category summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import CATEGORY_ORDER, category, category_rank, match_score, natural_key

#: Path lists as rows: id, pos (place in the list), path, size. A list is one cell of the item source, so that of one id fits a task:
#: everything here is grouped by id, or by id and something else, and one exchange by id does for it. Every file becomes several nodes after
#: that exchange, which its bytes do not tell, so large sources are ``dealt`` first.

#: Files of a task.
TASK_FILES = 150_000


def dealt(files: DataFrame, n: int) -> DataFrame:
    """``files``, those of an id together, over as many tasks as their number ``n`` asks for: a task's share stays the same however many there are."""
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES)), "id")


def file_rows(items: DataFrame, files: str = "file_list") -> DataFrame:
    """id, pos, path and size of every file of items with a (path, size) list."""
    return items.select("id", F.posexplode(files).alias("pos", "file")).select("id", "pos", "file.path", "file.size")


def separators(files: DataFrame) -> DataFrame:
    """id and separator: ``/`` if any path has one; else ``,`` if over half of the paths with a comma share their first segment; else empty."""
    head = F.when(F.col("path").contains(","), F.substring_index("path", ",", 1))
    by_head = files.groupBy("id", head.alias("head")).agg(F.count("*").alias("n"), F.max(F.col("path").contains("/")).alias("slash"))
    shared = F.sum(F.when(F.col("head").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))
    commas = F.sum(F.when(F.col("head").isNotNull(), F.col("n")).otherwise(0))
    vote = F.when(F.max("slash"), "/").when(2 * shared > commas, ",").otherwise("")
    return by_head.groupBy("id").agg(vote.alias("separator"))


def _split(path: Column, separator: Column) -> Column:
    whole = F.array(path)
    cut = F.when(separator == "/", F.split(path, "/", -1)).when(separator == ",", F.split(path, ",", -1)).otherwise(whole)
    return F.filter(cut, lambda s: s != "")


_MARK = "\u0000"


def _voted(files: DataFrame, separator: str | None) -> DataFrame:
    """``files`` with separator: the given one, or each id's own (as ``separators`` finds it, beside the rows)."""
    if separator is not None:
        return files.withColumn("separator", F.lit(separator))
    headed = files.withColumn("head", F.when(F.col("path").contains(","), F.substring_index("path", ",", 1)))
    whole = Window.partitionBy("id")
    # First what needs all rows of an id, so that the rest finds them together.
    headed = headed.withColumn("slash", F.max(F.col("path").contains("/")).over(whole)).withColumn("alike", F.count("*").over(Window.partitionBy("id", "head")))
    shared = F.count(F.when(F.col("head").isNotNull() & (F.col("alike") > 1), 1)).over(whole)
    vote = F.when(F.col("slash"), "/").when(2 * shared > F.count("head").over(whole), ",").otherwise("")
    return headed.withColumn("separator", vote).drop("head", "slash", "alike")


def _own(files: DataFrame) -> DataFrame:
    """One row a file: id, key (segments joined), n (how many), pos (where it first appeared) and last (place, size, path of its last mention)."""
    rows = files.select("id", "pos", "path", F.coalesce("size", F.lit(0.0)).cast("double").alias("size"), _split(F.col("path"), F.col("separator")).alias("parts"))
    rows = rows.where(F.size("parts") > 0).select("id", F.array_join("parts", _MARK).alias("key"), F.size("parts").alias("n"), "pos", "size", "path")
    return rows.groupBy("id", "key", "n").agg(F.min("pos").alias("pos"), F.max(F.struct("pos", "size", "path")).alias("last"))


def _nodes(files: DataFrame) -> DataFrame:
    """One row a node: id, prefix (segments so far), depth, at (where it first appeared), leaf (place, size, path), total and inner (has nodes below).

    Each file gives its size once to itself and to every directory above it, so one aggregation makes nodes and totals.
    """
    up = _own(files).select("id", "pos", "n", "last", F.split("key", _MARK).alias("parts")).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("depth"))
    rows = up.select("id", F.array_join(F.slice("parts", 1, F.col("depth")), _MARK).alias("prefix"), "depth", F.struct("pos", "depth").alias("at"), F.when(F.col("depth") == F.col("n"), F.col("last")).alias("leaf"), F.col("last.size").alias("size"), (F.col("depth") < F.col("n")).alias("inner"))
    return rows.groupBy("id", "prefix", "depth").agg(F.min("at").alias("at"), F.max("leaf").alias("leaf"), F.sum("size").alias("total"), F.max("inner").alias("inner"))


def directory_sizes(files: DataFrame, separator: str | None = None) -> DataFrame:
    """id, prefix (segments joined by ``/``), is_dir and total size of every node, without the tree's numbering."""
    sized = _nodes(_voted(files, separator))
    return sized.select("id", F.replace("prefix", F.lit(_MARK), F.lit("/")).alias("prefix"), F.col("leaf").isNull().alias("is_dir"), F.col("total").alias("size"))


def flat_tree(files: DataFrame, separator: str | None = None) -> DataFrame:
    """id, idx, name, parent (an idx, -1 at the root), is_dir, size and path (files only) of every node.

    Nodes are numbered by first appearance, so a parent stands before its children. A file and
    a directory of one name in one place are one node, a file; of a path that repeats the last
    size counts. ``separator``: for all ids; by default each id's own is found.
    """
    return _numbered(_voted(files, separator))


def _numbered(voted: DataFrame) -> DataFrame:
    numbered = _nodes(voted).withColumn("idx", F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1)
    above = F.when(F.col("depth") > 1, F.array_join(F.slice(F.split("prefix", _MARK), 1, F.col("depth") - 1), _MARK))
    # A node is a child beside its siblings, and once more, if it has nodes below, the parent beside them.
    child, parent = F.struct(above.alias("family"), F.lit(None).cast("int").alias("up")), F.struct(F.col("prefix").alias("family"), F.col("idx").alias("up"))
    rows = numbered.withColumn("as_", F.explode(F.when(F.col("inner"), F.array(child, parent)).otherwise(F.array(child)))).select("*", "as_.family", "as_.up")
    family = rows.withColumn("parent", F.max("up").over(Window.partitionBy("id", "family"))).where("up is null")
    return family.select("id", "idx", F.substring_index("prefix", _MARK, -1).alias("name"), F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("leaf").isNull().alias("is_dir"), F.col("total").alias("size"), "leaf.path")


def pruned_tree(files: DataFrame, categories: list[str], separator: str | None = None) -> DataFrame:
    """The tree of the files of some categories: empty directories go, sizes follow. The separator is that of all files."""
    voted = _voted(files, separator)
    last = F.try_element_at(_split(F.col("path"), F.col("separator")), F.lit(-1))
    return _numbered(voted.withColumn("last", last).where(F.col("last").isNotNull() & category(F.col("last")).isin(*categories)).drop("last"))


def sorted_children(nodes: DataFrame, words: list[str]) -> DataFrame:
    """``nodes`` with place: directories first, then most words matched, then names with numbers in them as numbers."""
    order = Window.partitionBy("id", "parent").orderBy(F.desc("is_dir"), F.desc(match_score(F.col("name"), words)), natural_key(F.col("name")), "idx")
    return nodes.withColumn("place", F.row_number().over(order))


def category_summary(nodes: DataFrame) -> DataFrame:
    """id, category, files, size and share (percent of all bytes) of the categories that an item has, with their display rank."""
    return _categories(nodes.where("not is_dir").select("id", "name", "size"))


def file_categories(files: DataFrame, separator: str | None = None) -> DataFrame:
    """The same from path lists, without making the tree."""
    return _categories(_own(_voted(files, separator)).select("id", F.substring_index("key", _MARK, -1).alias("name"), F.col("last.size").alias("size")))


def _categories(leaves: DataFrame) -> DataFrame:
    own = leaves.groupBy("id", category(F.col("name")).alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
    whole = F.sum("size").over(Window.partitionBy("id"))
    return own.select("id", "category", category_rank(F.col("category")).alias("rank"), "files", "size", F.when(whole > 0, 100 * F.col("size") / whole).alias("share"))


__all__ = ["CATEGORY_ORDER", "category_summary", "directory_sizes", "file_categories", "file_rows", "flat_tree", "pruned_tree", "separators", "sorted_children"]
