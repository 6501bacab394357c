"""Duplicate operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle import assert_same, duck
from pyspark.sql import functions as F

from tamarack.llm import components, embeddings, queries, simhash, substrings

SF = "/root/testdata/sf0.001"


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = {n: find(n) for n in parent if find(n) != n}
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    n = len(fps)
    label = list(range(n))
    array = np.array(fps, dtype=np.uint64)
    changed = True
    near = np.bitwise_count(array[:, None] ^ array[None]) <= 2
    label = np.arange(n)
    while changed:
        new = np.where(near, label[None], n).min(axis=1)
        changed = bool((new != label).any())
        label = new
    return label


@pytest.mark.parametrize("most", [512, 2])
def test_simhash(spark, most, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, most))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:150]
    rng = random.Random(1)
    base = rows[5][1].split()
    for i in range(40):  # a cloud of near copies
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "x"), (20_002, "x"), (20_003, "A b " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    least = {}
    for (d, _), c in zip(rows, label):
        least[c] = min(least.get(c, d), d)
    for (d, _), f, c in zip(rows, fps, label):
        assert got[d].fingerprint == f"{f:016x}" and got[d].component_id == least[c]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_cut(texts, length=200):
    count = collections.Counter()
    for t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most, stretch", [(500, 1 << 20), (1, 300)])
def test_substrings(spark, most, stretch, monkeypatch):
    monkeypatch.setattr(substrings.spans, "__defaults__", (200, most))
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(25):
        own = " ".join(word() for _ in range(rng.randrange(5, 120)))
        texts.append(own[: len(own) // 2] + passage[rng.randrange(40) : len(passage) - rng.randrange(40)] + own[len(own) // 2 :])
    texts += [texts[0], "ab " * 150, "x" * 199, "y" * 200, "y" * 200, "z" * 5000, "", None, "short", passage[:199], passage[:200]]
    rows = list(enumerate(texts)) + [(900, texts[3]), (900, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"q": F.lit("clash"), "_hash": F.col("doc_id") + 1, "id": F.lit("mine"), "Cuts": F.lit(3)})
    want = collections.Counter(zip((d for d, _ in rows), plain_cut([(t or "").encode() for _, t in rows])))
    got = collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.digests(df).collect())
    assert got == want
    out = substrings.remove(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("q = 'clash' and _hash = doc_id + 1 and id = 'mine' and Cuts = 3").count() == len(rows)
    assert out.where("doc_id = 900 and text = ''").count() == 2
    assert substrings.digests(df.limit(0)).count() == 0


def test_misled_hashes_are_caught():
    """A hash that is the same for everything still gives the right classes, since they are checked on bytes."""

    class Blind(substrings.Hashed):
        def of(self, start, end):
            return np.zeros(np.broadcast(start, end).shape, dtype=np.uint64)

    data = np.frombuffer(b"bananabandana", dtype=np.uint8)
    start = np.arange(len(data))
    size = len(data) - start
    first, end = np.zeros(len(data), dtype=int), np.full(len(data), len(data))
    order, lcp = substrings.classes(Blind(data), start, size, first, end)
    text = data.tobytes()
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want
    right_order, right_lcp = substrings.classes(substrings.Hashed(data), start, size, first, end)
    assert right_order.tolist() == want and right_lcp.tolist() == lcp.tolist()


class Weak(substrings.Hashed):
    """Polynomial hashes cut to two bits: most of them collide."""

    def of(self, start, end):
        return super().of(start, end) & np.uint64(3)


def test_weak_hashes_remove_nothing_wrongly(monkeypatch):
    rng = random.Random(5)
    gram = bytes(rng.choice(b"ab") for _ in range(48))
    tail = bytes(rng.choice(b"ab") for _ in range(152))
    contexts = [bytes(rng.choice(b"ab") for _ in range(152)) + gram + (tail if i % 3 else bytes(rng.choice(b"ab") for _ in range(152))) for i in range(30)]
    left, right, group = np.full(30, 152), np.full(30, 200), np.zeros(30, dtype=np.int64)
    want = substrings.repeats(contexts, left, right, group, 200)
    assert [bool(x) for x in want[0] + want[1]] == [i % 3 > 0 for i in range(30)]
    monkeypatch.setattr(substrings, "Hashed", Weak)
    got = substrings.repeats(contexts, left, right, group, 200)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    fields = {"doc_id": group, "text_hash": group, "q": np.arange(30, dtype=np.int32), "lhs": left.astype(np.int16), "rhs": right.astype(np.int16), "k": group + 1, "first": group.astype(np.int16), "last": (group + 200).astype(np.int16)}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, fields.values()), pa.array(contexts)], names=[*fields, "context"])
    seen = collections.defaultdict(set)
    for out in substrings._blocks(200, 40, False)([batch]):
        for r in out.to_pylist():
            seen[r["core"], r["whole"]].add(contexts[r["q"]][152 - r["high"] : 152 + 200 - r["low"]])
    assert seen and all(len(v) == 1 for v in seen.values())


def test_embeddings_against_sql(spark):
    assert_same(queries.op8_embeddings(spark, SF), duck(SF), queries.ORACLE_SQL["op8_embeddings"])


def test_embedding_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.08).tolist(), i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] * 8, 1), (104, base.tolist(), None), (105, base.tolist(), 0), (105, base.tolist(), 0), (106, base[:4].tolist(), 0), (None, (-base).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    for tile in (1024, 4):
        got = collections.defaultdict(list)
        for r in embeddings.near_duplicates(df, tile=tile).collect():
            got[r.vec_id].append((r.n_links, r.component_id))
        fine = [(i, np.array(v), c) for i, v, c in rows if c is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
        for k, (i, v, c) in enumerate(fine):
            links = sum(1 for j, (_, w, e) in enumerate(fine) if j != k and e == c and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98)
            assert all(n == links for n, _ in got[i]), (tile, i)
        for i in (100, 101, 102, 103, 104, 106):
            assert got[i] == [(0, i)]
        assert got[None] == [(0, None)] and len(got[105]) == 2
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_parts_of_a_tile_against_brute_force():
    rng = np.random.default_rng(8)
    for dim in (4, 12):  # 12 is not the model's dimension: no part is skipped
        model = embeddings.basis(rng.normal(size=(200, 4)))
        unit = rng.normal(size=(6, dim))[rng.integers(0, 6, 90)] + rng.normal(size=(90, dim)) * 0.1
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        every = np.arange(90)
        for left, right in ((every, every), (every[:37], every[37:])):
            got = []
            for i, j in embeddings.part_links(unit, left, right, model, 0.98, part=7):
                got += [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
            close = unit @ unit.T >= 0.98
            want = {(a, b) if a < b else (b, a) for a in left.tolist() for b in right.tolist() if a != b and close[a, b]}
            assert len(got) == len(set(got)) and set(got) == want and want


def test_joined_edges_a_part_at_a_time():
    rng = np.random.default_rng(9)
    for _ in range(30):
        i, j = rng.integers(0, 40, (2, 35))
        root, plain = np.arange(40), list(range(40))
        for k in range(0, 35, 6):
            root = embeddings.joined(root, i[k : k + 6], j[k : k + 6])
        for _ in range(40):
            for a, b in zip(i.tolist(), j.tolist()):
                plain[a] = plain[b] = min(plain[a], plain[b])
        assert root.tolist() == plain


def test_long_vectors_get_smaller_tiles(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, (np.ones(6) + rng.normal(size=6) * 0.1).tolist(), 1) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(embeddings.near_duplicates(df).collect())
    monkeypatch.setattr(embeddings, "NUMBERS", 30)  # five vectors a tile
    assert sorted(embeddings.near_duplicates(df).collect()) == whole
