"""Dictionary matching against plain containment."""

import random

import numpy as np
import pytest

from tamarack.operators import dictionary


def test_least_grams_of_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 3, 24, 25, 26, 60, 200):
        a = rng.integers(0, 50, n).astype(np.uint64)
        for width in (1, 2, 3, 25):
            want = {int(a[i : i + width].min()) for i in range(max(1, n - width + 1))}
            assert set(dictionary.least(a, width).tolist()) == want


@pytest.mark.parametrize("bits", [24, 3])
def test_against_plain_containment(spark, bits):
    rng = random.Random(bits)
    words = ["Alpha", "beta", "gamma", "Éclair", "日本", "d", "ee", "xyz", "longerword", "a" * 40]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, say(rng.randrange(1, 60))) for i in range(80)] + [(80, None), (81, ""), (1, say(5)), (82, "hot " * 400), (83, "É")]
    terms = [(i, say(rng.randrange(1, 7))) for i in range(60)] + [(60, None), (61, ""), (62, "é"), (63, "hot"), (64, "HOT hot"), (65, "never in any of them, however long"), (3, "beta"), (66, "b"), (67, "bet")]
    terms += [(100 + k, (t or "")[k : k + 5 + 3 * k]) for k, (_, t) in enumerate(texts[:20])]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = dictionary.match_dictionary(df, spark.createDataFrame(terms, "term_id long, term string").repartition(2), "id", "text", "term_id", "term", bits)
    want = {(i, k) for i, t in texts for k, x in terms if t and x and x.lower() in t.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and len(want) > 100
    assert dictionary.match_dictionary(df.limit(0), spark.createDataFrame(terms, "term_id long, term string"), "id", "text", "term_id", "term").count() == 0
    assert dictionary.match_dictionary(df, spark.createDataFrame([], "term_id long, term string"), "id", "text", "term_id", "term").count() == 0
