"""The pipeline on a small corpus, each stage against plain Python on its own input."""

import collections
import random

import numpy as np
import pytest
from test_private_data_and_warc import plain, plain_shares
from test_simhash_similar import plain_kept
from test_tokens import check_packing, library  # noqa: F401

import corpus_pipeline
from tamarack.llm import quality_classifier
from tamarack.llm.common import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, id string, Score double, predicted int"


def test_columns_of_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001").persist()
        assert after.columns == columns, name
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < after.count() <= before.count(), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def corpus(rng):
    """Good and bad texts, copies exact and near, a passage in many, personal data, nulls, empties and repeated rows."""
    good, bad = [f"fine{i}word" for i in range(400)], [f"zz{i}#" for i in range(30)]
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts, quality = [], []
    for k in range(160):
        junk = k % 5 == 4
        text = say(bad if junk else good, rng.randrange(60, 160))
        if k % 8 == 1:
            text += f" rare{k}name wrote from p{k % 3}@mail.example or +1 234 567 890{k % 9}"
        texts.append(text)
        quality.append(0 if junk else 1)
    passage = say(good, 60)
    for k in range(0, 40, 3):
        texts[k] = say(good, 200) + " " + passage + " " + say(good, 200)
    for k in (1, 2, 3, 6):
        texts.append(texts[k])
        words = texts[k].split()
        words[5] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[k] + (" " + " ".join(words[10:40])) * 5)
        quality += [1, 1, 1]
    texts += [None, "", "", "one word", "é" * 300]
    quality += [None] * 5
    rows = [(i, t, "en", "s", len(t or ""), -i, f"id{i}", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3]]
    return rows, [(i, q, 0) for i, q in enumerate(quality) if q is not None]


def plain_removed(texts, length=200):
    datas = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, datas):
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out.append(None if t is None else "".join(kept))
    return out


def plain_sanitised(texts):
    out = []
    for t, terms in zip(texts, plain_shares([t or "" for t in texts])):
        spans = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in plain(t or "").split(",") if x)]
        spans += [(a, b, "" if share >= 0.95 else "[TERM]") for a, b, share in terms]
        at, parts = 0, []
        for a, b, label in sorted(spans, key=lambda s: s[0]):
            if a < at:  # overlaps the one before: as one, under its label
                at = max(at, b)
                continue
            parts += [(t or "")[at:a], label]
            at = b
        out.append(None if t is None else "".join(parts) + t[at:])
    return out


@pytest.fixture(scope="module")
def folder(spark):
    rows, labels = corpus(random.Random(5))
    path = fresh_path(spark, "corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder, library):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda rows: sorted(map(tuple, rows), key=repr)

    kept = stage["quality_classifier"](spark, docs, folder)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality_classifier.WordScores(model)
    want = [r for r in docs.collect() if scores.score([quality_classifier.words_of(r.text)])[0] >= 0.3]
    assert key(kept.collect()) == key(want) and len(want) < docs.count()
    labelled = [(i in {r.doc_id for r in want}) == bool(q) for i, q, _ in corpus(random.Random(5))[1]]
    assert sum(labelled) >= 0.95 * len(labelled)

    kept = spark.createDataFrame(kept.collect(), docs.schema).repartition(2)
    singles = stage["simhash"](spark, kept, folder)
    rows = {r.doc_id: r for r in kept.collect()}
    least = plain_kept([(i, r.text) for i, r in rows.items()])
    assert key(singles.collect()) == key(rows[i] for i in least) and len(least) < len(rows)

    rows = sorted(singles.collect(), key=lambda r: r.doc_id)
    removed = stage["suffix_array"](spark, spark.createDataFrame(rows, docs.schema).repartition(2), folder)
    texts = plain_removed([r.text for r in rows])
    again = lambda r, t: (r.doc_id, t, r.lang, r.source, len(t or ""), *tuple(r)[5:])
    assert key(removed.collect()) == key(again(r, t) for r, t in zip(rows, texts)) and texts != [r.text for r in rows]

    rows = sorted(removed.collect(), key=lambda r: r.doc_id)
    clean = stage["personal_data"](spark, spark.createDataFrame(rows, docs.schema).repartition(2), folder)
    texts = plain_sanitised([r.text for r in rows])
    assert key(clean.collect()) == key(again(r, t) for r, t in zip(rows, texts)) and any("[EMAIL]" in (t or "") for t in texts)

    rows = clean.collect()
    packed = stage["packing"](spark, spark.createDataFrame(rows, docs.schema), folder)
    check_packing(packed.collect(), {r.doc_id: r.text for r in rows}, library)
    whole = corpus_pipeline.run(spark, folder).collect()
    check_packing(whole, {r.doc_id: r.text for r in rows}, library)


def test_empty_table(spark, folder):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.mode("overwrite").parquet(f"{folder}-none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}-none").count() == 0
