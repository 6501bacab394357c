"""Near-duplicates at a similarity against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

from tamarack.llm import simhash_similar


def plain_kept(rows):
    """By similarity alone: the radius must lose nothing here."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i for i in sets if find(i) == i}


def test_stage_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for n in (40, 60, 100, 300):  # copies with a few words changed, on both sides of the limit
        base = [word() for _ in range(n)]
        for changes in range(8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(80)]
    for _ in range(60):  # a large group in chains
        copy = list(hot)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(30))
    texts += [line + " " + " ".join(word() for _ in range(30)) for _ in range(30)]
    texts += [None, "", "one two", "One  two", texts[0], "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, -i, "h", 1) for i, t in rows], "doc_id long, text string, _id long, id string, n int").repartition(3)
    kept = simhash_similar.keep_first(df).collect()
    assert all(r._id == -r.doc_id and r.id == "h" and r.n == 1 for r in kept)  # names like those used inside
    got = Counter(r.doc_id for r in kept)
    assert set(got.values()) == {1} and set(got) == plain_kept(rows)
    odd = spark.createDataFrame([(None, "x y"), (3, "x y"), (3, "x y"), (None, "alone"), (None, None)], "doc_id long, text string")
    kept = simhash_similar.keep_first(odd).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, "alone"), (3, "x y")]
    assert simhash_similar.keep_first(df.limit(0)).count() == 0


def repeated_lines(rng, groups=8):
    """Texts in groups: one with a line once, copies that repeat the line up to 60 times, and near copies of either."""
    texts = []
    for _ in range(groups):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        line = [f"w{rng.randrange(3000)}" for _ in range(30)]
        for times in (1, 2, 5, 41, 60):
            texts.append(" ".join(body + line * times))
            near = list(body)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near + line * times))
    return texts


def test_repeated_lines_and_order_of_rows(spark):
    rows = list(enumerate(repeated_lines(random.Random(1))))
    want = plain_kept(rows)
    for k, order in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "doc_id long, text string")
        df = df.repartition(k) if k > 1 else df.coalesce(1)
        assert {r.doc_id for r in simhash_similar.keep_first(df).collect()} == want


def test_tiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "TILE_ROWS", 4)
    test_stage_against_brute_force(spark)


def test_marks_and_forest_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
    sets = []
    for n in (4, 40, 400):
        for _ in range(60):  # similarities on both sides of the limit
            s = base[:n].copy()
            at = rng.random(n) < rng.random() * 0.2
            s[at] = rng.integers(-(1 << 63), (1 << 63) - 1, at.sum())
            sets.append(np.unique(s))
    node, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    fp = np.array([simhash_similar.bits_of(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
    part, marks = node // 2, np.array([simhash_similar.marks_of(s) for s in sets], dtype=object)
    side = node, size, fp, part, marks
    near = lambda i, j: np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[j]) <= 20
    linked = {(i, j) for i, j in combinations(node.tolist(), 2) if part[i] != part[j] and near(i, j) and simhash_similar.alike(sets[i], sets[j])}
    got = [(min(i, j), max(i, j)) for x, y in simhash_similar.tile_pairs(side, side, 20) for i, j in zip(x.tolist(), y.tolist())]
    assert linked and linked <= set(got) and len(set(got)) == len(got)
    a, b = simhash_similar.forest(side, side, 20, (part, part), lambda i, j: simhash_similar.alike(sets[i], sets[j]))
    assert {(min(x, y), max(x, y)) for x, y in zip(a, b)} <= linked and len(a) < len(np.unique(part))

    def roots(pairs):
        tree = {p: p for p in part.tolist()}
        for i, j in pairs:
            x, y = tree[part[i]], tree[part[j]]
            tree = {k: x if v == y else v for k, v in tree.items()}
        return {frozenset(k for k in tree if tree[k] == v) for v in tree.values()}

    assert roots(zip(a, b)) == roots(linked)


def test_rows_of_a_large_group(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(80)]
    texts = []
    for k in range(300):  # each shares its keys with nearly all, and is near, but seldom near enough
        copy = list(base)
        copy[4 + rng.randrange(72)] = f"v{k}"
        texts.append(" ".join(copy))
    counts, plain = {}, simhash_similar.materialize

    def counting(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash_similar, "materialize", counting)
    rows = list(enumerate(texts))
    kept = simhash_similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == plain_kept(rows)
    assert max(counts.values()) == counts["met-keys"] < 20 * len(rows)
