"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tamarack.llm import periodic_runs


def brute_runs(words):
    n, out, seen = len(words), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if length >= max(24, 3 * q) and (a, length) not in seen:  # smaller periods came first
                seen.add((a, length))
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def random_text(rng):
    words = []
    for _ in range(rng.randrange(1, 9)):
        kind, sigma = rng.randrange(4), rng.choice([1, 2, 3, 50])
        base = [f"w{rng.randrange(sigma)}" for _ in range(rng.randrange(1, 30))]
        words += base * rng.randrange(1, 12) if kind else base
        if kind == 2 and words:
            words[rng.randrange(len(words))] = "x"
    return rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)


def test_cover():
    assert {(int(y) - int(x)) % periodic_runs.MOD for x in periodic_runs.COVER for y in periodic_runs.COVER} == set(range(periodic_runs.MOD))


@pytest.mark.parametrize("seed", range(4))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 30, 31, 62, 200, 700):
        s = rng.integers(0, 2, n) if seed % 2 else np.tile(rng.integers(0, 3, 7), n // 7 + 1)[:n]
        e = periodic_runs.Extensions(s)
        i, j = np.triu_indices(min(n, 90), 1)
        j = j + n - min(n, 90)
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            k = 0
            while b + k < n and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert e.right(i, j).tolist() == want


@pytest.mark.parametrize("most", [1 << 21, 50])
def test_find_runs(most, monkeypatch):
    monkeypatch.setattr(periodic_runs.grids, "__defaults__", (most,))
    rng = random.Random(most)
    for _ in range(60):
        texts = [random_text(rng).split() for _ in range(rng.randrange(1, 6))]
        texts += [["a"] * k for k in (23, 24, 25)] + [list("ab") * 12, list("ab") * 11 + ["a"], []]
        known = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        values, starts, at = [], [], 0
        for k, t in enumerate(texts):
            starts.append(at)
            values += [known[w] for w in t] + [len(known) + k]
            at = len(values)
        sizes = np.array([len(t) for t in texts])
        got = periodic_runs.find_runs(np.array(values), np.array(starts), sizes)
        want = [(s + a, length, q) for a, t in zip(starts, texts) for s, length, q in brute_runs(t)]
        assert list(zip(*(g.tolist() for g in got))) == want


def test_query_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, random_text(rng), "x") for i in range(150)] + [(150, None, "x"), (151, "", "x"), (152, " \n ", None), (153, "é\x1fa " * 40, "x"), (7, random_text(rng), "x")]
    rows.append((154, " ".join(f"w{rng.randrange(3000)}" for _ in range(20000)) + " again and" * 3000, "x"))
    rows += [rows[3]] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = [tuple(r) for r in periodic_runs.digests(df).collect()]
    assert sorted((r for r in got if r[0] != 154), key=repr) == sorted((brute_row(i, t) for i, t, _ in rows if i != 154), key=repr)
    long = [r for r in got if r[0] == 154]
    assert len(long) == 1 and long[0][1:6] == (1, 20000, 6000, 2, 3000000)
    assert periodic_runs.digests(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b " * 20), (None, None)], "doc_id long, text string")
    assert sorted(r.n_runs for r in periodic_runs.digests(odd).collect()) == [0, 1]
