"""Quality rules: a linear-chain CRF labels each line content or boilerplate; content share decides.

The CRF is learned from documents whose quality is labelled: lines of a document of quality 1 stand
for content and those of quality 0 for boilerplate at first (distant labels). What a first CRF then finds clearly of the other
kind by its own features, whatever its neighbours, is labelled so: boilerplate lines of good documents and clean lines
of bad ones. The second CRF learns from these, from the documents and from as many texts spliced of runs of good and bad
ones, so that its transitions know how labels switch inside a text. Viterbi decoding labels the lines of every whole text.

Null text counts as empty: no words, base rules fail, not kept. A text of one very long line is one
line. Rows that repeat are judged alike, each on its own, and ties of two labels go to content. Other columns of the
input are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, remainder, slices
from .crf import Adam, marginals, viterbi

SYMBOLS = "#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
#: Upper edges of the buckets of each line feature; a line has one active bucket for each feature.
EDGES = (
    (1, 3, 7, 15, 40),  # words
    (0, 0.02, 0.06, 0.12),  # symbols to characters
    (0.15, 0.35, 0.6),  # upper case to letters
    (0, 0.1, 0.3),  # digits to characters
    (0.35, 0.6, 0.8, 0.99),  # distinct words to words
    (0, 0.1, 0.3),  # words that equal the word before
    (0, 0.02, 0.06),  # ! and ? to characters
    (3, 6, 9),  # mean word length
    (0,),  # ends like a sentence
    (0,),  # equals an earlier line
    (0,),  # first line
)
OFFSETS = np.concatenate(([0], np.cumsum([len(e) + 1 for e in EDGES])))
N_FEATURES = int(OFFSETS[-1])
_TABLE = bytes(range(256))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text in UTF-8."""
    words = data.split()
    n_symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    word_chars = sum(map(len, words)) - len(data.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        last = -1
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    return len(words), word_chars, n_symbols, n_dup_lines, repeated


def line_features(data: bytes) -> tuple[list[tuple], list[int]]:
    """Raw feature values and length in bytes of every line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        upper = len(line) - len(line.translate(None, _UPPER))
        lower = len(line) - len(line.translate(None, _LOWER))
        digits = len(line) - len(line.translate(None, b"0123456789"))
        symbols = len(line) - len(line.translate(None, SYMBOLS.encode()))
        marks = len(line) - len(line.translate(None, b"!?"))
        echo = sum(map(bytes.__eq__, words, words[1:]))
        rows.append((n, symbols / chars, upper / (upper + lower + 1), digits / chars, len(set(words)) / n, echo / n, marks / chars, chars / n, words[-1][-1:] in b".!?", line in seen, not seen))
        seen.add(line)
        sizes.append(chars)
    return rows, sizes


def buckets(rows: list[tuple]) -> np.ndarray:
    """Indices of the active features, one row for each line."""
    raw = np.array(rows, dtype=np.float64).reshape(-1, len(EDGES))
    return np.stack([np.searchsorted(np.array(e), raw[:, k], side="left") + OFFSETS[k] for k, e in enumerate(EDGES)], axis=1)


def _learn(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int, rate: float, decay: float) -> dict:
    weights, trans = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    hot = np.eye(2)[y]
    inner = np.setdiff1d(np.arange(1, len(y)), np.cumsum(lengths))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    a, b = Adam(weights.shape, rate), Adam(trans.shape, rate)
    for _ in range(epochs):
        p, expected = marginals(weights[x].sum(axis=1), lengths, trans, pairs=True)
        diff = (hot - p) / len(y)
        grad = np.stack([np.bincount(x.ravel(), weights=np.repeat(diff[:, k], x.shape[1]), minlength=N_FEATURES) for k in (0, 1)], axis=1)
        a.step(weights, grad - decay * weights)
        b.step(trans, (seen - expected) / len(y) - decay * trans)
    return {"weights": weights, "trans": trans}


def splices(lengths: np.ndarray, quality: np.ndarray, rng: np.random.Generator, mean: int = 6) -> list[np.ndarray]:
    """Lines (their numbers) of texts that take turns: a run of a good text, a run of a bad one, and so on to the ends of both."""
    starts = np.cumsum(lengths) - lengths
    good, bad = (rng.permutation(np.flatnonzero(quality == q)) for q in (1, 0))
    out = []
    for i in range(len(lengths) if len(good) and len(bad) else 0):
        pair = [good[i % len(good)], bad[i % len(bad)]]
        at, turn, lines = [0, 0], i % 2, []
        while at[turn] < lengths[pair[turn]]:
            end = min(at[turn] + int(rng.geometric(1 / mean)), lengths[pair[turn]])
            lines.append(np.arange(at[turn], end) + starts[pair[turn]])
            at[turn], turn = end, 1 - turn
        out.append(np.concatenate(lines))
    return out


def train(texts: list[str], labels: list[int], epochs: int = 80, rate: float = 0.1, decay: float = 1e-4, sure: float = 0.9) -> dict:
    """Weights by gradient ascent on the likelihood of the line labels (Adam, full batch)."""
    feats, lengths, quality = [], [], []
    for text, good in zip(texts, labels):
        rows, _ = line_features((text or "").encode("utf-8", "replace"))
        if rows:
            feats.extend(rows)
            lengths.append(len(rows))
            quality.append(int(bool(good)))
    if not feats:
        return {"weights": np.zeros((N_FEATURES, 2)), "trans": np.zeros((2, 2))}
    x, lengths, quality = buckets(feats), np.array(lengths), np.array(quality)
    y = np.repeat(np.where(quality == 1, CONTENT, BOILERPLATE), lengths)
    first = _learn(x, y, lengths, epochs, rate, decay)
    score = first["weights"][x].sum(axis=1)
    clear = np.abs(score[:, 0] - score[:, 1]) >= np.log(sure / (1 - sure))
    y = np.where(clear, score.argmax(axis=1), y)
    mixed = splices(lengths, quality, np.random.default_rng(3))
    lines = np.concatenate([np.arange(len(y)), *mixed])
    return _learn(x[lines], y[lines], np.concatenate((lengths, np.array([len(m) for m in mixed], dtype=np.int64))), epochs, rate, decay)


def fit(documents: DataFrame, labels: DataFrame, sample: int = 3000) -> dict:
    """Learn from at most ``sample`` labelled documents that aren't held out (crc32 of doc_id mod 5 isn't 0).

    The sample is bounded: the rows with the smallest hash of doc_id.
    """
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0))
    chosen = hash_sample(rows.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample)
    got = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(2 * sample).collect()
    return train([r.text for r in got], [int(r.quality) for r in got])


def content_shares(texts: list[bytes], model: dict) -> list[float]:
    """Share of the word bytes that lie in lines decoded as content, for each text (no line: 0)."""
    rows, lengths, sizes = [], [], []
    for data in texts:
        r, s = line_features(data)
        rows.extend(r)
        sizes.extend(s)
        lengths.append(len(r))
    if not rows:
        return [0.0] * len(texts)
    labels = viterbi(model["weights"][buckets(rows)].sum(axis=1), np.array(lengths), model["trans"])
    sizes, doc = np.array(sizes, dtype=np.float64), np.repeat(np.arange(len(texts)), lengths)
    total = np.bincount(doc, weights=sizes, minlength=len(texts))
    content = np.bincount(doc, weights=sizes * (labels == CONTENT), minlength=len(texts))
    return (content / np.maximum(total, 1)).tolist()


def judge(documents: DataFrame, model: dict, min_share: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                shares = content_shares(texts, shared.value)
                counts = [base_counts(t) for t in texts]
                failed = [c[0] < min_words or 100 * c[4] > max_repeat * c[0] for c in counts]
                columns = [part.column(0), *map(list, zip(*counts)), failed, [not f and s >= min_share for f, s in zip(failed, shares)], shares]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
