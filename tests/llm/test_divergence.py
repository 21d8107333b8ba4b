import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.divergence import divergence, terms

SCHEMA = "text string, lang string, source string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def said(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(rows, most=200):
    docs = [(said(t), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in docs}:
        own = [(t, s) for t, g, s in docs if g == lang]
        held = Counter(x for t, _ in own for x in set(t))
        kept = sorted(x for x, n in held.items() if n >= 3)
        counts = {s: Counter(x for t, z in own if z == s for x in t) for s in {s for _, s in own}}
        whole = Counter(x for t, _ in own for x in t)

        def shares(c):
            total = sum(c[x] for x in kept) + len(kept)  # noqa: B023
            return {x: 1 + 10**9 * (c[x] + 1) // total for x in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(-sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept), o.encode(), o) for o in counts if o != s]
            found = [(-((p[s][x] - q[x]) ** 2 // q[x]), x.encode(), x) for x in kept if counts[s][x] > 0 and p[s][x] > q[x]]
            for part, items, limit in (("pair", pairs, None), ("term", found, most)):
                out |= {(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(sorted(items)[:limit], 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, n=220):
    rnd = random.Random(seed)
    vocabulary = ["Ab", "ab", "É", "é", "straße", "日本", "x1y", "it's", "Z"] + [f"{a}{b}" for a in "pqrs" for b in "uvwxyz"]
    rows = []
    for _ in range(n):
        k = rnd.choice([0, 1, 5, 30])
        text = rnd.choice([" ", "-", "\n", "_9"]).join(rnd.choice(vocabulary[: rnd.randint(3, len(vocabulary))]) for _ in range(k))
        rows.append((text if k or rnd.random() < 0.5 else None, rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["a", "b", "Ü", None, "z z"])))
    return rows + [("", "none", "one"), ("once only", "none", "two"), ("a b c " * 20, "single", "s"), *[("a b c", "single", "s")] * 3]


def test_rows_are_those_of_plain_counting(spark):
    rows = random_rows(1)
    assert got(divergence(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ranks_and_frequencies_are_parameters(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)
    rows = random_rows(2, 80)
    assert got(divergence(spark.createDataFrame(rows, SCHEMA), most_terms=3)) == brute(rows, 3)


def test_only_ascii_letters_are_lower_cased(spark):
    texts = ["ÀB İI A\x00B [x]^`{y}~ 9z", "", "AB CD", "K", "ſ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(terms(F.col("t"))).collect()] == [said(t) for t in texts]


def test_large_counts_are_exact(spark):
    """Counts of over 2**63 / 10**9, which only decimals hold."""
    from quarry.llm.divergence import dense_shares

    n = 30_000_000_000
    counts = spark.createDataFrame([("en", "s", "big", n, 5)], "lang string, source string, term string, count long, docs long")
    sizes = spark.createDataFrame([("en", "s", n + 4, n + 4, 3)], "lang string, source string, n long, n_lang long, v long")
    kept = spark.createDataFrame([("en", "big", n)], "lang string, term string, count long")
    row = dense_shares(counts, sizes, kept).first()
    assert row["p"] == row["q"] == 1 + 10**9 * (n + 1) // (n + 7)


def test_defined_cases(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(None, None, None), ("x y", "g", "s")], SCHEMA).withColumns({"term": F.lit(1), "item": F.lit(2), "p": F.lit(3), "Rank": F.lit(4)})
    assert divergence(odd).collect() == []
    two = spark.createDataFrame([(None, "g", "a"), ("", "g", "b")], SCHEMA)
    assert got(divergence(two)) == {("g", "a", "pair", "b", 0, 1), ("g", "b", "pair", "a", 0, 1)}
