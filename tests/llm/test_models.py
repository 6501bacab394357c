"""Learned operators: decoding against brute force, and held-out accuracy on the test tables."""

import collections
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import crf, language_id, line_quality, quality_classifier, queries
from tamarack.llm.subword import Subwords

SF = "/root/testdata/sf0.001"


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1])
    emission, trans = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    labels, p = crf.viterbi(emission, lengths, trans), crf.marginals(emission, lengths, trans)
    at = 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n))) if n else []
        scores = np.array([sum(emission[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])) for path in paths])
        if n:
            assert tuple(labels[at : at + n]) == paths[scores.argmax()]
            share = np.exp(scores - scores.max())
            share /= share.sum()
            for i in range(n):
                for k in range(3):
                    assert abs(p[at + i, k] - sum(s for s, path in zip(share, paths) if path[i] == k)) < 1e-9
        at += n


def test_subwords_are_those_of_each_word_alone():
    words = ["a", "abc", "énorm", "x" * 40]
    together = Subwords(words, (2, 3, 4), 16)
    for i, w in enumerate(words):
        alone = Subwords([w], (2, 3, 4), 16)
        assert alone.whole[0] == together.whole[i]
        for a, ids, owner in zip(alone.ids, together.ids, together.word):
            assert sorted(a) == sorted(ids[owner == i])


def test_blocks_carry_the_whole_chain():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 0, 7, 23, 4, 8])
    emission, trans = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3)) * 2
    want, pairs = crf.marginals(emission, lengths, trans, pairs=True, block=1000)
    for block in (1, 2, 4, 7):
        got, expected = crf.marginals(emission, lengths, trans, pairs=True, block=block)
        assert np.allclose(got, want) and np.allclose(expected, pairs)
    # a first word that settles all others reaches to the end of a text of 5000 words
    emission, trans = np.zeros((5000, 2)), np.array([[0.0, -40.0], [-40.0, 0.0]])
    emission[0] = (30, 0)
    assert (crf.marginals(emission, np.array([5000]), trans)[:, 0] > 0.999).all()


def many_language_model(k, bits=12):
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(1 << bits, k)).astype(np.float32) for _ in language_id.SIZES]
    return {"languages": [f"l{i:03d}" for i in range(k)], "bits": bits, "tables": tables, "lexicon": {"abc": 0}, "lexicon_weights": rng.normal(size=(1, k)), "trans": rng.normal(size=(k, k)) * 0.3}


@pytest.mark.parametrize("k, cells", [(3, 1 << 22), (3, 60), (20, 1 << 22), (20, 300)])
def test_judged_texts_against_plain_forward_backward(k, cells):
    rng = random.Random(k)
    emissions = language_id.Emissions(many_language_model(k, 8))
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 30, 700, 5, 0, 1, 300)] + [None, "12 3", "abc ABC abc"]
    best, score, lengths, switches = language_id.judge_texts(texts, emissions, cells)
    trans = emissions.model["trans"]
    for t, b, s, n, m in zip(texts, best, score, lengths, switches):
        words = language_id.words_of(t)
        assert n == len(words)
        if not words:
            assert (s, m) == (0, 0)
            continue
        e = emissions(words)
        ahead, behind = [e[0]], [np.zeros(k)]
        logs = lambda x: np.log(np.exp(x - x.max(axis=0)).sum(axis=0)) + x.max(axis=0)
        for row in e[1:]:
            ahead.append(logs(ahead[-1][:, None] + trans) + row)
        for row in e[:0:-1]:
            behind.append(logs((trans + (row + behind[-1])[None, :]).T))
        p = np.array(ahead) + np.array(behind[::-1])
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        assert b == p.sum(axis=0).argmax() and abs(s - p.sum(axis=0).max() / n) < 1e-9
        assert m == (np.diff(p.argmax(axis=1)) != 0).sum()


def test_memory_of_many_languages():
    """300 languages, 20,000 short texts and one of 5,000 words in one slice: under 300 MB."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(30000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(20000)] + [" ".join(rng.choice(vocabulary) for _ in range(5000))]
    emissions = language_id.Emissions(many_language_model(300))
    tracemalloc.start()
    best, _, lengths, _ = language_id.judge_texts(texts, emissions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and lengths.sum() == 165000 and len(best) == 20001


def test_words_are_letters_only():
    assert language_id.words_of("½ ² ⅷ ١") == [] and language_id.words_of("a½b Été٣x _y") == ["a", "b", "été", "x", "y"]


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "WEIGHTS", 1 << 19)
    rng = np.random.default_rng(6)
    word = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" + "".join(rng.choice(list("aeiou"), 3))
    rows = [(3 * i + j, " ".join(word(i) for _ in range(30)), f"l{i:03}") for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows + [(9000, "½ ²", "l001"), (9001, None, None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    learned = {r.lang for r in df.where("lang is not null and pmod(crc32(cast(doc_id as string)), 5) != 0").select("lang").distinct().collect()}
    assert model["languages"] == sorted(learned) and len(learned) > 256
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert (got[9000].lang_pred, got[9000].score) == (got[9001].lang_pred, got[9001].score) == ("und", 0.0)
    known = [(i, lang) for i, _, lang in rows if lang in learned]
    assert np.mean([got[i].lang_pred == lang for i, lang in known]) > 0.9


def test_code_switched_text():
    rng = np.random.default_rng(8)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(60)] for lang, letters in (("x", "abcde"), ("y", "fghij"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    model = language_id.train([text(lang, 40) for lang in "xyxyxy"], list("xyxyxy"))
    p, lengths = language_id.label_words([text("x", 3000) + " " + text("y", 2500), text("y", 3)], language_id.Emissions(model))
    assert lengths.tolist() == [5500, 3]
    assert (p[:, 0] > 0.5).tolist() == [True] * 3000 + [False] * 2503


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_base_counts_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op1_quality_rules(spark, SF).collect()
    want = collections.Counter()
    for doc_id, text in docs:
        n = plain_base(text or "")
        want[(doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.content_share >= 0.5) for r in got)


def test_labels_switch_inside_a_text():
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "harbour", "walked", "quietly", "evening"], 12)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "###", "$$$", "99", "!!!"], 6))
    texts = ["\n".join(f() for _ in range(8)) for f in (good, bad) * 30]
    model = line_quality.train(texts, [1, 0] * 30)
    lines = [good() for _ in range(5)] + [bad() for _ in range(4)] + [good() for _ in range(3)]
    rows, sizes = line_quality.line_features("\n".join(lines).encode())
    labels = crf.viterbi(model["weights"][line_quality.buckets(rows)].sum(axis=1), np.array([len(rows)]), model["trans"])
    assert labels.tolist() == [0] * 5 + [1] * 4 + [0] * 3
    share = line_quality.content_shares(["\n".join(lines).encode()], model)[0]
    assert abs(share - sum(s for s, y in zip(sizes, labels) if y == 0) / sum(sizes)) < 1e-12


def test_base_counts():
    assert line_quality.base_counts(b"") == (0, 0, 0, 0, 0)
    assert line_quality.base_counts("a b c\na b c\n\n \né #".encode()) == (8, 8, 1, 1, 6)
    n, *_, repeated = line_quality.base_counts(b"x " * 10)
    assert (n, repeated) == (10, 10)
    assert line_quality.base_counts(b"w" * 200_000)[:2] == (1, 200_000)


def edge_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "   \n ", "en"), (4, "word " * 30_000, "en"), (5, "same text", "de"), (5, "same text", "de"), (None, "123 456", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))


def test_edges_of_all_three(spark):
    docs = edge_rows(spark)
    empty = docs.limit(0)
    model = line_quality.train(["good line here.\nnext line."] * 3 + ["### $$$ ***\n%%% &&&"] * 3, [1] * 3 + [0] * 3)
    judged = line_quality.judge(docs, model)
    got = {r.doc_id: r for r in judged.collect()}
    assert judged.count() == 7 and got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[4].n_words == 30_000
    assert line_quality.judge(empty, model).count() == 0
    lm = language_id.train(["the and of the", "der und die das"], ["en", "de"])
    pred = {r.doc_id: r for r in language_id.predict(docs, lm).collect()}
    assert pred[1].lang_pred == pred[3].lang_pred == pred[None].lang_pred == "und" and pred[None].held_out is False
    assert pred[4].n_words == 30_000 and 0 <= pred[4].score <= 1
    assert language_id.predict(docs, language_id.train([], [])).where("lang_pred = 'und'").count() == 7
    qm = quality_classifier.train(["fine words here", "### ***"], [1, 0])
    assert quality_classifier.scored(docs, qm).where("score between 0 and 1").count() == 7
    assert quality_classifier.keep_good(docs, qm, 0.0).columns == docs.columns
    assert quality_classifier.scored(empty, qm).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.9 * lang.count()
    kept = queries.op1_quality_rules(spark, SF).join(labels, "doc_id").where("NOT base_failed")
    assert kept.where("quality = 1 AND kept").count() >= 0.95 * kept.where("quality = 1").count()
    scored = queries.op6_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out")
    assert scored.where("(score >= 0.3) = (quality = 1)").count() >= 0.9 * scored.count()
