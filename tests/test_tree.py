import random
from collections import Counter

from quarry import queries
from quarry.operators import tree

SCHEMA = "id long, pos int, path string, size double"


def separator_of(paths):
    """The rule, restated on plain lists."""
    if any("/" in p for p in paths):
        return "/"
    heads = Counter(p.split(",")[0] for p in paths if "," in p)
    shared = sum(n for n in heads.values() if n > 1)
    return "," if 2 * shared > sum(heads.values()) else ""


def tree_of(files, separator=None):
    """A tree of paths keyed by their segments: place of first appearance, then sizes from all leaves below."""
    separator = separator_of([p for p, _ in files]) if separator is None else separator
    first, leaves = {}, {}
    for path, size in files:
        parts = tuple(s for s in (path.split(separator) if separator else [path]) if s)
        for d in range(1, len(parts) + 1):
            first.setdefault(parts[:d], len(first))
        if parts:
            leaves[parts] = (size, path)
    return [
        (i, key[-1], first.get(key[:-1], -1) if len(key) > 1 else -1, key not in leaves, sum(s for k, (s, _) in leaves.items() if k[: len(key)] == key), leaves.get(key, (0, None))[1])
        for key, i in sorted(first.items(), key=lambda x: x[1])
    ]


def got(df):
    return [(r["idx"], r["name"], r["parent"], r["is_dir"], r["size"], r["path"]) for r in df.orderBy("idx").collect()]


def test_a_file_and_a_directory(spark):
    files = [("Movie.mkv", 8589934592.0), ("Sample/sample.txt", 1024.0)]
    df = spark.createDataFrame([(2, i, *f) for i, f in enumerate(files)], SCHEMA)
    assert got(tree.flat_tree(df)) == [(0, "Movie.mkv", -1, False, 8589934592.0, "Movie.mkv"), (1, "Sample", -1, True, 1024.0, None), (2, "sample.txt", 1, False, 1024.0, "Sample/sample.txt")]


def test_random_lists(spark):
    rnd, rows, expected = random.Random(5), [], {}
    for i in range(150):
        joint = rnd.choice(["/", "/", ",", "."])
        files = []
        for _ in range(rnd.randint(1, 9)):
            parts = [rnd.choice(["a", "b", "c", "", "d e"]) for _ in range(rnd.randint(1, 4))]
            files.append((joint.join(parts), float(rnd.randint(0, 9))))
        rows += [(i, k, *f) for k, f in enumerate(files)]
        expected[i] = tree_of(files)
    found = {}
    for r in tree.flat_tree(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "idx").collect():
        found.setdefault(r["id"], []).append((r["idx"], r["name"], r["parent"], r["is_dir"], r["size"], r["path"]))
    assert {i: x for i, x in expected.items() if x} == found


def test_categories_and_pruning(spark):
    files = [("a/x.mkv", 6.0), ("a/y.txt", 1.0), ("b/z.flac", 3.0), ("w.MKV", 0.0)]
    df = spark.createDataFrame([(1, i, *f) for i, f in enumerate(files)], SCHEMA)
    summary = tree.category_summary(tree.flat_tree(df)).orderBy("rank").collect()
    assert [(r["category"], r["files"], r["size"], r["share"]) for r in summary] == [("video", 2, 6.0, 60.0), ("audio", 1, 3.0, 30.0), ("other", 1, 1.0, 10.0)]
    pruned = [(r["name"], r["is_dir"], r["size"], r["path"]) for r in tree.pruned_tree(df, ["audio", "other"]).orderBy("idx").collect()]
    assert pruned == [("a", True, 1.0, None), ("y.txt", False, 1.0, "a/y.txt"), ("b", True, 3.0, None), ("z.flac", False, 3.0, "b/z.flac")]
    assert tree.pruned_tree(df, []).count() == 0


def test_children(spark):
    files = [("e10.mkv", 1.0), ("e9.mkv", 1.0), ("key.txt", 1.0), ("dir/x", 1.0)]
    df = spark.createDataFrame([(1, i, *f) for i, f in enumerate(files)], SCHEMA)
    placed = tree.sorted_children(tree.flat_tree(df).where("parent = -1"), ["key"]).orderBy("place")
    assert [r["name"] for r in placed.collect()] == ["dir", "key.txt", "e9.mkv", "e10.mkv"]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tree.flat_tree(empty).count() == 0 and tree.separators(empty).count() == 0
    nulls = spark.createDataFrame([(1, 0, None, None), (1, 1, "", 2.0), (1, 2, "a", None)], SCHEMA)
    assert got(tree.flat_tree(nulls)) == [(0, "a", -1, False, 0.0, "a")]


def test_one_exchange_and_no_join(spark):
    files = spark.range(8).selectExpr("id % 2 as id", "cast(id as int) pos", "concat('a/', id) path", "1.0D size")
    plan = tree.flat_tree(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_tasks_grow_with_the_files(spark, data, monkeypatch):
    """A task's share, and so its memory, stays the same; nothing is dealt again after that."""
    monkeypatch.setattr(tree, "TASK_FILES", 100)
    files = queries.line_files(spark, data)
    tasks = -(-files.count() // 100)
    assert tasks > 4 and files.rdd.getNumPartitions() == tasks
    for name in ("flat_tree", "dir_rollup", "category_prune", "sorted_children", "category_summary"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(id" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan, name
