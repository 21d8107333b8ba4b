import itertools
import math
import random

from pyspark.sql import functions as F

from quarry import queries
from quarry.engine import Engine
from quarry.operators.readings import possible_words, readings, segmented
from quarry.operators.suggest import suggestions
from quarry.sources.items import ITEM_SCHEMA

TABLE = [("重", "zhong"), ("庆", "qing"), ("重庆", "chong qing"), ("银", "yin"), ("行", "xing"), ("银行", "yin hang"), ("女", "nü"), ("神", "shen"), ("Q", "q"), ("", "x"), ("空", " ")]


def said(spark, terms, table=TABLE):
    words = spark.createDataFrame([(t,) for t in terms], "term string")
    return {r["term"]: (r["full"], r["initials"]) for r in readings(words, spark.createDataFrame(table, "text string, reading string")).collect()}


def test_longest_phrases_first(spark):
    got = said(spark, ["重庆银行", "重银行", "女神1080P", "行", "plain", "庆重庆x", "々空"])
    assert got == {
        "重庆银行": ("chongqingyinhang", "cqyh"),
        "重银行": ("zhongyinhang", "zyh"),
        "女神1080P": ("nvshen1080p", "ns1080p"),
        "行": ("xing", "x"),
        "庆重庆x": ("qingchongqingx", "qcqx"),
        "々空": ("々空", "々空"),
    }
    assert said(spark, ["重庆"], []) == {"重庆": ("重庆", "重庆")}
    assert said(spark, []) == {}


def test_random_words(spark):
    rnd = random.Random(4)
    chars = "啊波次得饿"
    table = [(c, f"{chr(97 + i)}{chr(98 + i)}") for i, c in enumerate(chars[:4])]
    table += [("".join(p), " ".join(rnd.choice(["xu", "yo", "zi"]) for _ in p)) for n in (2, 3) for p in itertools.product(chars, repeat=n) if rnd.random() < 0.2]
    known = {}
    for t, r in table:
        known[t] = min(known.get(t, r.split()), r.split())
    terms = {"".join(rnd.choice(chars + "k") for _ in range(rnd.randint(1, 9))) for _ in range(150)}

    def plain(term):
        full = initials = ""
        at = 0
        while at < len(term):
            n = max((n for n in range(1, 4) if term[at : at + n] in known and len(term[at : at + n]) == n), default=0)
            if n:
                full += "".join(known[term[at : at + n]])
                initials += "".join(x[0] for x in known[term[at : at + n]])
            else:
                full, initials = full + term[at], initials + term[at]
            at += max(n, 1)
        return full, initials

    assert said(spark, sorted(terms), table) == {t: plain(t) for t in terms if set(t) & set(chars)}


def test_segmented_as_all_cuts():
    rnd = random.Random(9)
    for _ in range(300):
        run = "".join(rnd.choice("高清影视家") for _ in range(rnd.randint(1, 7)))
        counts = {w: rnd.randint(1, 50) for w in possible_words(run) if rnd.random() < 0.5}
        total = sum(counts.values()) + 1
        cuts = []
        for marks in itertools.product([0, 1], repeat=len(run) - 1):
            words, last = [], 0
            for i, m in enumerate(marks, 1):
                if m:
                    words.append(run[last:i])
                    last = i
            words.append(run[last:])
            seen = [counts.get(w, 1 if len(w) == 1 else 0) for w in words]
            if all(seen):
                cuts.append((-sum(math.log(s / total) for s in seen), words))
        least = min(c for c, _ in cuts)
        got = segmented(run, counts)
        assert "".join(got) == run and any(w == got and c <= least + 1e-6 for c, w in cuts)
    assert segmented(" Movie-1080P 同人CG集 ", {"同人": 5}) == ["movie", "1080p", "同人", "cg", "集"]
    assert segmented("高清影视", {"高清": 3, "影视": 2, "清影": 1}) == ["高清", "影视"]
    assert segmented("...", {}) == [] and possible_words("abc") == set()


def test_typed_characters_and_readings_in_the_engine(spark, tmp_path):
    names = ["高清 影视", "高清", "影视 重庆", "重庆 movie", "清影", "mocha"]
    rows = [(i, n, None, None, "[]", 1, 1) for i, n in enumerate(names)]
    engine = Engine(spark, str(tmp_path / "store"), hot_min_docs=1)
    engine.rebuild(spark.createDataFrame(rows, ITEM_SCHEMA))
    assert engine.typed("高清影视") == ["高清", "影视"] and engine.typed("ab 重") == ["ab", "重"]
    assert engine.suggest("高清影视") == ["影视", "高清"]  # as often, so in the order of the terms
    read = engine.readings(spark.createDataFrame(TABLE, "text string, reading string"))
    assert engine.suggest("chongq", readings=read) == ["重庆"] and engine.suggest("cq", readings=read) == ["重庆"]
    # Stored n-grams and first ranks give what scoring every word gives.
    ranking = engine.keywords.ranking().select("term", "rank")
    for text in ("mo", "o", "moca", "影", "movei", "ch"):
        assert engine.suggest(text) == [r["term"] for r in suggestions(ranking, engine.typed(text)).collect()]
    engine.keywords.add(["高清"])
    assert engine.suggest("高清影视") == ["影视"] and engine.keywords.top(2).select(F.collect_list("term")).first()[0] == ["影视", "重庆"]


def test_the_words_are_made_once(spark, data):
    plan = queries.term_readings(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
