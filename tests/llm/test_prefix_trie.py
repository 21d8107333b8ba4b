import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quarry.llm import common, prefix_trie
from quarry.llm.prefix_trie import as_they_are, rebuilt, turn_rows

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Turns of each conversation in order: null first, ties by the MD5 of role and text."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    return {c: [(r, t) for _, _, r, t in sorted(own, key=lambda x: (x[0], x[1], digest(x[2], x[3])))] for c, own in convs.items()}


def lent(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - int(c / 20) * 20 and c - (abs(c) % 20) * (1 if c > 0 else -1), []) if c % 20 else own
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    """Every node with its members, and sums over all nodes below."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def random_rows(seed, n=60):
    rnd, rows, bases = random.Random(seed), [], []
    for c in range(n):
        kind = rnd.random()
        turns = list(rnd.choice(bases)) if bases and kind < 0.7 else []
        if kind < 0.2:
            turns = turns[: rnd.randint(0, len(turns))]
        elif kind > 0.35:  # longer than what it begins with, so chains hang on chains
            turns += [(rnd.choice(["user", "assistant", None]), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) or None) for _ in range(rnd.randint(0, 3))]
        turns = turns or [("user", "a")]
        bases.append(turns)
        conv = c - 5 if c % 7 else 3 * c
        rows += [(conv, i if i or rnd.random() < 0.8 else None, r, t) for i, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    return rows


def test_nodes_are_those_of_all_prefixes(spark):
    rows = random_rows(1)
    turns = turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.prefix_trie(*as_they_are(turns))) == brute(sequences(rows))


def test_rebuilt_conversations(spark):
    rows = random_rows(2, 90) + [(None, 1, "user", "lost")]
    turns = turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.prefix_trie(*rebuilt(turns))) == brute(lent(sequences(rows)))


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    monkeypatch.setattr(prefix_trie, "LONG", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    rows = random_rows(3, 40)
    long = [(900 + k, i, "user", f"turn {i if i < 30 - k else -i * k}") for k in range(4) for i in range(40)]
    long += [(950 + k, i, "user", f"turn {i}") for k in range(9) for i in range(25)]  # all end at one node
    rows += long + [(990, None, "user", f"{i}") for i in range(6)]
    turns = turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.prefix_trie(*as_they_are(turns))) == brute(sequences(rows))


def test_a_ladder_of_chains(spark):
    """Each conversation goes one turn on from the one before it: chains hang on chains as deep as there are conversations."""
    rows = [(c, i, "user", f"word{i} x") for c in range(1, 14) for i in range(c)]
    turns = turn_rows(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.prefix_trie(*as_they_are(turns))) == brute(sequences(rows))


def test_defined_cases(spark):
    empty = turn_rows(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.prefix_trie(*rebuilt(empty)).collect() == []
    odd = spark.createDataFrame([(7, None, None, None), (7, None, None, None)], SCHEMA).withColumns({"depth": F.lit(1), "conv": F.lit("x"), "digest": F.lit(0)})
    assert got(prefix_trie.prefix_trie(*as_they_are(turn_rows(odd)))) == brute({7: [("", ""), ("", "")]})
    # Conversation 1 lends two turns of conversation 0, which is absent, so nothing of it is left.
    assert zlib.crc32(b"1") % 4 == 3
    alone = turn_rows(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], SCHEMA))
    assert got(prefix_trie.prefix_trie(*rebuilt(alone))) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
