"""Sequence packing by non-negative least squares over the histogram of piece lengths.

A document's ids (the end id included) are cut into pieces of 2048 and a rest. Length combinations of up to four
pieces that fill the window exactly are enumerated; non-negative least squares against
the histogram of lengths says how often each should be used. The counts are rounded down to what the
histogram holds, and what is left over is packed greedily, largest length first, each gap filled with
the largest length that fits. The plan lists lengths and counts only: it is bounded by the window,
not by the number of documents. Pieces then find their places by their rank among pieces of equal length.

Null text counts as empty: one piece with the end id alone. Very long texts become many pieces.
Repeated rows are packed each on its own (their pieces take different places). A null doc_id stays null.
Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

WINDOW, END = 2048, 1
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a text with a byte-level vocabulary file; special tokens in a text are single ids."""

    def __init__(self, path: str):
        import tiktoken

        from .bpe import byte_characters

        spec = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.path = path
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.slow = None

    def ids(self, text: str | None) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text or "", allowed_special="all").astype(np.uint32)
        except BaseException as e:  # noqa: BLE001  the library panics on white space beyond its pattern engine's stack
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.no_truncation()
                self.slow.no_padding()
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): the pieces of every document, 2048 ids or fewer each."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, salt int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                rows, start, length, crc, total, salt = [], [], [], [], [], []
                for row, (text, spread) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    ids = np.append(encoder.ids(text), np.uint32(END)).astype("<u4")
                    data = ids.tobytes()
                    for at in range(0, len(ids), WINDOW):
                        rows.append(row)
                        start.append(at)
                        length.append(min(WINDOW, len(ids) - at))
                        crc.append(zlib.crc32(data[4 * at : 4 * (at + WINDOW)]))
                        total.append(len(ids))
                        salt.append((spread + at // WINDOW) & 0x7FFFFFFF)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(salt, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", spread.alias("spread")).mapInArrow(run, schema)


# --- the plan ------------------------------------------------------------------------------------


def combinations_for(histogram: np.ndarray, window: int, partners: int = 12) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill the window exactly, made of lengths that occur.

    All single lengths, all pairs, and for each length the triples and quadruples with ``partners``
    companions spread over the lengths that occur.
    """
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    known = np.zeros(2 * window + 1, dtype=bool)
    known[have] = True
    rows = []
    if known[window]:
        rows.append((window, 0, 0, 0))
    for a in have[have <= window // 2].tolist():
        if known[window - a]:
            rows.append((window - a, a, 0, 0))
    short = have[have < window]
    if len(short):
        # companions: the most frequent lengths, and lengths at even steps
        often = short[np.argsort(-histogram[short], kind="stable")[:partners]]
        even = short[np.linspace(0, len(short) - 1, min(len(short), 4 * partners)).astype(int)]
        mates = np.unique(np.concatenate((often, even)))
        for b in mates.tolist():
            a = short[(short < window - b)]
            c = window - b - a
            ok = known[c] & (c <= a)
            rows.extend((x, y, b, 0) for x, y in zip(a[ok].tolist(), c[ok].tolist()))
        few = mates[:: max(1, len(mates) // partners)]
        for i, b in enumerate(few.tolist()):
            for e in few[: i + 1].tolist():
                a = short[short < window - b - e]
                c = window - b - e - a
                ok = known[c] & (c <= a)
                rows.extend((x, y, b, e) for x, y in zip(a[ok].tolist(), c[ok].tolist()))
    return np.unique(np.sort(np.array(rows, dtype=np.int64).reshape(-1, 4), axis=1)[:, ::-1], axis=0)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit the histogram: accelerated projected gradient on sparse columns."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    weight = 1.0 / np.maximum(np.sqrt(histogram), 1.0)  # errors count relative to what there is
    target = histogram * weight
    target[0] = 0
    used = (combos > 0).astype(float)

    def forward(x):
        return np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=size) * weight

    def back(r):
        return ((r * weight)[combos] * used).sum(axis=1)

    v = np.random.default_rng(3).random(len(combos))
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - target) / (1.05 * norm))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left of a histogram: largest first, each gap filled with the largest length that fits."""
    left = left.copy()
    out = []
    while True:
        lengths = np.flatnonzero(left)
        lengths = lengths[lengths > 0]
        if not len(lengths):
            return out
        combo, gap, free = [], window, left.copy()
        while True:
            fit = np.searchsorted(lengths, gap, side="right") - 1
            while fit >= 0 and not free[lengths[fit]]:
                fit -= 1
            if fit < 0:
                break
            n = int(lengths[fit])
            combo.append(n)
            free[n] -= 1
            gap -= n
        used = np.bincount(combo, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((tuple(combo), times))


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences that hold every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations_for(left, window)
    counts = np.floor(solve(combos, left.astype(float)) + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        lengths = combos[i][combos[i] > 0]
        used = np.bincount(lengths, minlength=len(left))
        times = min(int(counts[i]), int((left[lengths] // used[lengths]).min()))
        if times > 0:
            left -= used * times
            out.append((tuple(lengths.tolist()), times))
    return out + greedy(left, window)


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> list[dict]:
    """For each length the ranges of ranks, where they go: rank r of a range is sequence first + r - low at the offset."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            low = used.get(n, 0)
            used[n] = low + times
            out.setdefault(n, []).append((low, low + times, first, offset))
            offset += n
        first += times
    return [{"length": n, "low": a, "high": b, "first": f, "offset": o} for n, rows in out.items() for a, b, f, o in rows]


# --- the operator --------------------------------------------------------------------------------


def pack(documents: DataFrame, path: str, rows_per_task: int = 500_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Pieces of one length are ranked inside salted parts of it, so that no task gets a whole length: there are
    512 parts, or more if parts of ``rows_per_task`` pieces need it.
    """
    spark = documents.sparkSession
    cut = materialize(pieces(documents, path), "pieces")
    histogram = np.zeros(WINDOW + 1, dtype=np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # one row for each length: WINDOW at most
        histogram[r["length"]] = r["n"]
    salts = max(512, int(histogram.max()) // rows_per_task)
    cut = cut.withColumn("salt", F.expr(f"salt % {salts}"))
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    bounds = materialize(counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    schema = "length int, slots array<struct<low long, high long, first long, offset long>>"
    grouped: dict[int, list[tuple]] = {}
    for s in slots(plan(histogram)):
        grouped.setdefault(s["length"], []).append((s["low"], s["high"], s["first"], s["offset"]))
    places = spark.createDataFrame(list(grouped.items()), schema)  # bounded by the plan, the plan by the window
    ranked = cut.withColumn("rank", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, start, ids_crc32) - 1"))
    placed = ranked.join(bounds, ["length", "salt"]).withColumn("rank", F.expr("rank + before")).join(F.broadcast(places), "length")
    out = placed.withColumn("slot", F.expr("element_at(filter(slots, s -> rank >= s.low AND rank < s.high), 1)"))
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", F.expr("slot.first + rank - slot.low").alias("sequence_id"), F.expr("slot.offset").alias("offset"))


def padding(packed: DataFrame) -> DataFrame:
    """Sequences, tokens and padding tokens; a sequence whose length is a power of two is not padded."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.expr(f"CASE WHEN (n & (n - 1)) = 0 THEN 0 ELSE {WINDOW} - n END")
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))
