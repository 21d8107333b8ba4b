from collections import Counter

import pytest
from pyspark.sql import functions as F

from oracle import same
from quarry.llm import quality_rules as qr
from quarry.llm.queries import ORACLES, QUERIES

PROSE = " ".join(f"word{i} {'goes' if i % 4 else f'went{i}'}" if i % 9 else f"and{i}" for i in range(80)) + " " + " ".join(f"more{i}" for i in range(80))


def plain(text):
    """The measures, restated on lists."""
    w = (text or "").encode().split()
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


TEXTS = [None, "", " \n ", "a", "a b a b a b", "x y z x y z", PROSE, PROSE + "\n" + PROSE, "\n".join(["same line"] * 60), "SHOUT " * 60, PROSE.upper(), "% " * 70, "été\x0bà b " * 30, "q" * 200_000, "a " * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    t = qr.Text(text)
    assert (t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words) == plain(text)


def test_verdicts(spark):
    names = ["few_words", "repeated_words", "symbols", "repeated_lines", "capitals", "one_word", "word_length"]
    junk = {"few_words": "too short", "repeated_words": "a b c d e f " * 20, "symbols": PROSE.replace("goes", "go#"), "capitals": PROSE.upper(), "word_length": " ".join(f"{i}{'x' * 30}" for i in range(60)), "one_word": " ".join(f"k{i} the" for i in range(60))}
    own = " ".join(f"u{i}" for i in range(60))
    junk["repeated_lines"] = own + "\n" + "\n".join(["x", "y"] * 3)
    by = {r.name: r for r in qr.BASE_RULES + qr.RULES}
    assert sorted(by) == sorted(names)
    for name, text in junk.items():
        assert by[name].rejects(qr.Text(text)), name
    assert not any(r.rejects(qr.Text(PROSE)) for r in by.values())
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, junk["symbols"]), (3, junk["symbols"])], "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("verdict", F.lit(0))
    got = qr.apply_rules(df, statistics=True)
    assert got.columns[:4] == ["doc_id", "text", "kept", "verdict"]
    rows = sorted((r["doc_id"], r["kept"], r["kept_"], r["rejected_by"]) for r in got.select("doc_id", "kept", "kept_", F.coalesce("rejected_by", F.lit("")).alias("rejected_by")).collect())
    assert [x[2] for x in rows] == [True, False, False, False]
    assert qr.apply_rules(df.limit(0)).count() == 0


def test_order_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = [sorted((r["doc_id"], r["kept"]) for r in qr.apply_rules(df, rules).collect()) for rules in (qr.BASE_RULES + qr.RULES, tuple(reversed(qr.BASE_RULES + qr.RULES)))]
    assert found[0] == found[1]


def test_cascade_is_ordered_and_stops(spark):
    cheap, dear = qr.Rule("cheap", lambda t: len(t.text) % 2 == 0), qr.Rule("dear", lambda t: sum(range(20_000)) < 0)
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    plan = qr.plan_cascade(df, (dear, cheap))
    assert [e.rule.name for e in plan] == ["cheap", "dear"]
    assert plan[0].rejected == pytest.approx(0.5, abs=0.1) and plan[1].rejected == 0
    assert {r["rejected_by"] for r in qr.apply_rules(df, (dear, cheap)).collect()} == {"cheap", None}


def test_shared_work_is_charged_once():
    a, b = qr.Rule("a", None, ("words",)), qr.Rule("b", None, ("words",))
    c = qr.Rule("c", None, ())
    plan = qr.in_order((a, b, c), {"words": 10.0, "a": 1.0, "b": 1.0, "c": 4.0}, {"a": 0.5, "b": 0.3, "c": 0.3})
    assert [(e.rule.name, e.seconds) for e in plan] == [("c", 4.0), ("a", 11.0), ("b", 1.0)]


def test_the_sample_is_of_every_partition(spark):
    """A table sorted by what rules reject: only its last part is rejected, and the sample sees that."""
    df = spark.range(0, 4000, 1, 8).selectExpr("id doc_id", f"if(id < 3000, '{PROSE}', 'short') text")
    plan = {e.rule.name: e for e in qr.plan_cascade(df, sample_rows=5)}
    assert plan["few_words"].rejected == pytest.approx(0.25)


def test_query(spark, data):
    same(QUERIES["op4_quality_rules"](spark, data), ORACLES["op4_quality_rules"], data)
