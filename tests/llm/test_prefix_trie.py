"""The trie of rebuilt conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tamarack.llm import prefix_trie


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(rng, convs=60):
    rows, said = [], [f"turn {i} é" for i in range(4)] + [None, ""]
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(said[: rng.choice([1, 6])])))
    rows += [(None, 0, "user", "nobody's")] + rows[:3]
    for c in (200, 201, 202, 205, 500, 501):  # copies of one conversation, and one that is its beginning
        rows += [(c, t, "user", f"same {t}") for t in range(12 - c // 100)]
    return rows


def found(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, depth string").repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.nodes(df).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = random_rows(random.Random(seed))
    assert found(spark, rows) == brute(rows)


def test_long_conversation_over_many_partitions(spark):
    rows = [(5, t, "user", f"t{t % 3}") for t in range(3000)] + [(6, t, "user", f"t{t % 3}") for t in range(2500)] + [(7, 0, "a", "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collisions_are_found_and_left_behind(spark, monkeypatch):
    rows = random_rows(random.Random(5), 30)
    turns = prefix_trie.bases
    monkeypatch.setattr(prefix_trie, "bases", lambda seed: [0, 0, 0] if seed == 0 else turns(seed))  # all sequences alike at first
    monkeypatch.setattr(prefix_trie, "pow", lambda b, e, p: 0 if b == 0 and e else pow(b, e, p), raising=False)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.nodes(empty).count() == 0
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4)]  # no head to begin with, mostly passed over
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(None, 1, "a", "b")]) == []
