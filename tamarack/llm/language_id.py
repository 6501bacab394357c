"""Language identification: a linear-chain CRF labels every word; forward-backward sums up the text.

Emissions come from hashed affixes and character n-grams (sizes 2 to 4 with the word's edges) and
from a lexicon of words seen in training; transitions between neighbouring words are learned with
them, so runs of one language inside code-switched text hold together. A text is one chain, whatever its
length. A text's language has the largest share of its words' marginals.

Null text, or a text without a letter: ``und``, score 0. Words are runs of letters; a very long text
is labelled whole. Every language that a row to learn from names is learned; equal words and repeated rows count as
often as they stand there, and ties go to the language first in order. Rows that repeat are predicted alike. Nothing but
the text is read for a prediction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder, slices
from .crf import Adam, marginal_chunks, marginals
from .subword import Subwords

WORD = re.compile(r"[^\W\d_]+")
SIZES, BITS = (2, 3, 4), 16
#: Weights of a table of n-grams at most, over all languages: with more than 64 of them, n-grams share more places.
WEIGHTS = 1 << 22
#: Numbers (words times languages) that are worked on at once, and that the scores of words met before take.
CELLS, KEPT = 1 << 22, 1 << 23
#: With more languages, chains go item by item: a transfer matrix for each block would cost more than it saves.
FEW = 16
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; numerals and marks that the pattern takes for letters part words."""
    words = WORD.findall(text.lower()) if text else []
    if not words or text.isascii():
        return words
    return [x for w in words for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Emissions:
    """Log scores of a word for each language, kept for words met before (at most ``keep`` of them, fewer of very many languages)."""

    def __init__(self, model: dict, keep: int = 200_000):
        self.model, self.keep = model, min(keep, KEPT // max(1, len(model["languages"])))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(model["languages"])))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.keep:
            self.index, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            scores = Subwords(new, SIZES, self.model["bits"]).sums(self.model["tables"])
            lexicon = self.model["lexicon"]
            at = np.fromiter((lexicon.get(w, -1) for w in new), np.int64, len(new))
            scores[at >= 0] += self.model["lexicon_weights"][at[at >= 0]]
            first = len(self.index)
            self.index.update((w, first + i) for i, w in enumerate(new))
            self.rows = np.concatenate((self.rows, scores))
        return self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def train(texts: list[str], langs: list[str], epochs: int = 25, rate: float = 0.08, decay: float = 1e-6, min_count: int = 3) -> dict:
    """Maximum likelihood by Adam; every word of a training text carries the text's language."""
    languages = sorted(set(langs))
    docs = [words_of(t) for t in texts]
    keep = [i for i, d in enumerate(docs) if d]
    docs, gold = [docs[i] for i in keep], [languages.index(langs[i]) for i in keep]
    counts = Counter(w for d in docs for w in d)
    vocab = list(counts)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= min_count))}
    k = len(languages)
    bits = min(BITS, int(np.log2(WEIGHTS / max(1, k))))
    tables = [np.zeros((1 << bits, k)) for _ in SIZES]
    lex, trans = np.zeros((len(lexicon), k)), np.eye(k)
    model = {"languages": languages, "bits": bits, "tables": tables, "lexicon": lexicon, "lexicon_weights": lex, "trans": trans}
    if not docs:
        return model
    sub = Subwords(vocab, SIZES, bits)
    place = {w: i for i, w in enumerate(vocab)}
    flat = np.fromiter((place[w] for d in docs for w in d), np.int64)
    lengths = np.array([len(d) for d in docs])
    gold = np.array(gold)
    total = len(flat)
    at = np.fromiter((lexicon.get(w, -1) for w in vocab), np.int64, len(vocab))
    steps = [Adam(t.shape, rate) for t in (*tables, lex, trans)]
    # texts are worked on by the million of marginals
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(ends, np.arange(0, total, max(1, (4 << 20) // k)), side="right")
    cuts = np.unique(np.append(cuts, len(docs)))
    for _ in range(epochs):
        emission = sub.sums(tables)
        emission[at >= 0] += lex[at[at >= 0]]
        per_word, change = np.zeros((len(vocab), k)), np.zeros((k, k))
        for a, b in zip(cuts, cuts[1:]):
            words = flat[ends[a] - lengths[a] : ends[b - 1]]
            p, expected = marginals(emission[words], lengths[a:b], trans, pairs=True)
            p = -p
            p[np.arange(len(p)), np.repeat(gold[a:b], lengths[a:b])] += 1
            for j in range(k):
                per_word[:, j] += np.bincount(words, weights=p[:, j], minlength=len(vocab))
            change += np.diag(np.bincount(gold[a:b], weights=lengths[a:b] - 1, minlength=k)) - expected
        per_word /= total
        for ids, word, table, step in zip(sub.ids, sub.word, tables, steps):
            grad = np.stack([np.bincount(ids, weights=per_word[word, j], minlength=1 << bits) for j in range(k)], axis=1)
            step.step(table, grad - decay * table)
        grad = np.zeros_like(lex)
        grad[at[at >= 0]] = per_word[at >= 0]
        steps[-2].step(lex, grad - decay * lex)
        # a prior count keeps switches possible, although each training text has one language
        steps[-1].step(trans, change / total - 1e-3 * trans)
    for t in tables:
        t[:] = np.round(t, 5)
    model["tables"] = [t.astype(np.float32) for t in tables]
    return model


def fit(documents: DataFrame, per_language: int = 120, in_all: int = 4000) -> dict:
    """Learn from about ``per_language`` documents of each language (the bound of the sample), of very many languages fewer: about ``in_all`` in all, but eight of each.

    Only rows whose crc32(doc_id as text) mod 5 isn't 0 and whose lang isn't null. Which of them is a
    matter of the hash of doc_id; the languages themselves are counted over all rows.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0))
    counts = materialize(rows.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")), "languages")
    known = counts.count()
    each = min(per_language, max(8, in_all // max(1, known)))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # a row for each language, all of which the model holds anyway; small languages give all they have
    counts = F.broadcast(counts) if known <= 10_000 else counts
    some = rows.select("doc_id", "text", "lang").join(counts, F.col("lang") == F.col("name")).where(share * F.col("n") < each)
    got = some.select("doc_id", "text", "lang").orderBy("doc_id", "text", "lang").limit(2 * each * max(1, known)).collect()
    return train([r.text for r in got], [r.lang for r in got])


def label_words(texts: list[str | None], emissions: Emissions) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word in turn, and the number of words of each text."""
    docs = [words_of(t) for t in texts]
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    flat = [w for d in docs for w in d]
    if not emissions.model["languages"]:
        return np.zeros((len(flat), 1)), lengths
    return _chains(emissions, flat, lengths), lengths


def _chains(emissions: Emissions, words: list[str], lengths: np.ndarray) -> np.ndarray:
    trans = emissions.model["trans"]
    return marginals(emissions(words), lengths, trans, block=256 if len(trans) <= FEW else max(256, int(lengths.max(initial=0))))


def judge_texts(texts: list[str | None], emissions: Emissions, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the language of the largest share, that share, its number of words and of switches between languages.

    Texts are taken together as long as words (and texts) times languages stay below ``cells``; a longer one goes chunk by chunk.
    """
    k = max(1, len(emissions.model["languages"]))
    docs = [words_of(t) for t in texts]
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    best, score, switches = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
    if not emissions.model["languages"]:
        return best, score, lengths, switches
    first = 0
    while first < len(docs):
        end, words = first, 0
        while end < len(docs) and (end == first or (words + int(lengths[end]) + end - first) * k <= cells):
            words += int(lengths[end])
            end += 1
        if words * k > cells:
            sums, switches[first] = _by_chunks(docs[first], emissions, max(1, cells // (4 * k)))
            sums = sums[None, :]
        else:
            own = lengths[first:end]
            p = _chains(emissions, [w for d in docs[first:end] for w in d], own)
            doc = np.repeat(np.arange(end - first), own)
            sums = np.stack([np.bincount(doc, weights=p[:, j], minlength=end - first) for j in range(k)], axis=1)
            label = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            switch = (label[1:] != label[:-1]) & (doc[1:] == doc[:-1])
            switches[first:end] = np.bincount(doc[1:], weights=switch, minlength=end - first).astype(np.int64)
        best[first:end] = sums.argmax(axis=1)
        score[first:end] = np.minimum(sums.max(axis=1) / np.maximum(lengths[first:end], 1), 1.0)
        first = end
    return best, score, lengths, switches


def _by_chunks(words: list[str], emissions: Emissions, chunk: int) -> tuple[np.ndarray, int]:
    sums, switches, later = np.zeros(len(emissions.model["languages"])), 0, None
    for _, p in marginal_chunks(lambda a, b: emissions(words[a:b]), len(words), emissions.model["trans"], chunk):
        sums += p.sum(axis=0)
        label = p.argmax(axis=1)
        switches += int((label[1:] != label[:-1]).sum()) + (later is not None and int(label[-1]) != later)
        later = int(label[0])
    return sums, switches


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and the number of words of each predicted language."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        languages, emissions = shared.value["languages"], Emissions(shared.value)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                best, score, lengths, switches = judge_texts(part.column(2).to_pylist(), emissions)
                known = [bool(m) and bool(languages) for m in lengths]
                named = pa.array([languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), named, pa.array([float(s) if ok else 0.0 for s, ok in zip(score, known)]), pa.array(lengths), pa.array(switches)], names=names)

    held = remainder("doc_id") == 0
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, schema)
