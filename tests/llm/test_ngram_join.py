import random

import numpy as np
import pytest

from quarry.llm import common, ngram_join
from quarry.llm.ngram_join import asked, chosen_level, first_level, jaccard_join, least_shared

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LETTERS))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent):
    """Every pair compared, then components by walking."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    near = {i: set() for i, _ in rows}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i, s in sets:
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        out[i] = (len(s), min(seen))
    return out


def result(spark, rows, k=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, k, percent).collect()}


def corpus(words, copies=60, seed=3):
    """Copies with few and many edits, chains of edits, a passage that many share, exact copies, short and empty texts."""
    rnd = random.Random(seed)

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            out[rnd.randrange(len(out))] = f"e{rnd.randrange(40)}"
        return out

    base, passage, rows = words(150, 1), words(60, 2), []
    for i in range(copies):
        rows.append(edited(base, rnd.randrange(9)))
    chain = words(120, 4)
    for _ in range(12):
        chain = edited(chain, 2)
        rows.append(chain)
    for i in range(20):
        rows.append(words(80, 100 + i) + passage)
    rows += [words(90, 100)] * 4 + [["One", "two"], ["one", "TWO"], ["one"], [], ["x", "y", "z"]]
    rnd.shuffle(rows)
    return [(7 * i + 1, " ".join(r)) for i, r in enumerate(rows)] + [(3, None), (5, " \t\n ")]


def test_links_are_those_of_all_pairs(spark, words):
    rows = corpus(words)
    assert result(spark, rows) == brute(rows, 4, 85)


def test_hot_keys_change_nothing(spark, words, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(common, "SPOTS", 8)  # more hot keys than are told apart
    rows = corpus(words, 30, 8)
    assert result(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_all_is_left_to_the_exact_step(spark, words, monkeypatch):
    """Without any star round, counted matches alone find every link."""
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda live, number, percent: live.where("false").selectExpr("id as u", "id as v"))
    rows = corpus(words, 25, 5)
    assert result(spark, rows) == brute(rows, 4, 85)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "q")], "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as n_shingles", "3 as token")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["component_id"]) for r in jaccard_join(odd, 5, 80).collect())
    assert got == [(False, 0, None), (True, 4, 4), (True, 4, 4), (True, 9, 9)]


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_prefixes_keep_what_they_promise(percent):
    """Random sets in one order: those that link share as many shingles in their prefixes as the shorter prefix asks for."""
    rnd = random.Random(percent)
    for n in range(1, 300):
        assert 1 <= first_level(n, percent) <= least_shared(n, percent) <= n
        assert first_level(n, percent) <= first_level(n + 1, percent)
        assert asked(n, percent) <= first_level(n, percent)
    linked = 0
    for _ in range(3000):
        one = sorted(rnd.sample(range(400), rnd.randint(2, 120)))
        other = sorted(set(one) - set(rnd.sample(one, rnd.randint(0, len(one) // 4))) | set(rnd.sample(range(400), rnd.randint(0, 4))))
        common_ = len(set(one) & set(other))
        if not other or 100 * common_ < percent * (len(one) + len(other) - common_):
            continue
        linked += 1
        level = min(rnd.randint(1, least_shared(len(x), percent)) for x in (one, other))
        prefixes = [x[: len(x) - least_shared(len(x), percent) + level] for x in (one, other)]
        assert len(set(prefixes[0]) & set(prefixes[1])) >= level
    assert linked > 100 or percent == 100


def test_the_level_follows_the_cost():
    alone = np.array([2] * 100)
    assert chosen_level(np.array([2] * 10), 100, 85) == 0  # too few shared shingles in any prefix
    cheap, dear = chosen_level(alone, 100, 85), chosen_level(np.array([2] * 40 + [5000] * 60), 100, 85)
    assert 1 <= cheap and 1 <= dear <= 25  # a frequent shingle is not taken in for one match more
    assert chosen_level(np.array([1000] * 15 + [2] * 85), 100, 85) > cheap or cheap == 85
