"""Runs of periodically repeated words, found on harmonic grids by extensions over difference-cover samples.

A run is a stretch of consecutive words with smallest period q and length ``max(SHORTEST, 3 q)`` at least that no
neighbouring word extends. Words q apart are equal all along it, so the places i with word i = word i + q form a stretch
of ``max(SHORTEST, 3 q) - q`` at least, and one place of every grid of that step lies in it. Over all periods these grids
hold about n/2 ln n places (a harmonic sum). From each place whose two words are equal, the longest common extensions to
the right and, in the reversed words, to the left give the whole stretch.

Extensions: only suffixes at places whose remainder by 31 lies in a difference cover are sorted (word by word up to 31
words, then by doubling). For any two places some shift below 31 brings both to sampled places, so an extension compares
that many words at most and then takes the minimum of the sorted neighbours' common prefixes from a sparse table.

The words of many documents lie in one flat array with a separator of its own after each, so no extension leaves its
document. Null or empty text has no words and no runs. Repeated rows are separate documents. A null doc_id is a
document like any other. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SHORTEST = 24
#: Each remainder by MOD is a difference of two members of COVER.
MOD, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
_SLOT = np.full(MOD, -1)
_SLOT[COVER] = np.arange(len(COVER))
_FROM = np.zeros(MOD, dtype=np.int64)
for _x in COVER.tolist():
    for _y in COVER.tolist():
        _FROM[(_y - _x) % MOD] = _x
GRID = 2 << 20
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """Longest common extensions to the right between places of an array of numbers from 0."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.values = np.concatenate([values.astype(np.int64), np.full(2 * MOD, -1)])
        self.at = (np.arange(0, self.n + 1, MOD)[:, None] + COVER).ravel()
        self.at = self.at[self.at <= self.n]
        self._sort()

    def _split(self, active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order the active samples, which share their rank with another, by ``key`` too; those that still share it."""
        order = np.lexsort((key, self.rank[active]))
        active, key = active[order], key[order]
        rank, index = self.rank[active], np.arange(len(active))
        outer = np.concatenate(([True], rank[1:] != rank[:-1]))
        inner = outer | np.concatenate(([True], key[1:] != key[:-1]))
        self.rank[active] = rank + np.maximum.accumulate(np.where(inner, index, 0)) - np.maximum.accumulate(np.where(outer, index, 0))
        single = inner & np.concatenate((inner[1:], [True]))
        return active[~single]

    def _sort(self) -> None:
        m = len(self.at)
        self.rank, active = np.zeros(m, dtype=np.int64), np.arange(m) if m > 1 else np.zeros(0, dtype=np.int64)
        for k in range(MOD):
            if len(active):
                active = self._split(active, self.values[self.at[active] + k])
        levels, step = [self.rank.copy()], len(COVER)
        while len(active):  # ranks by MOD, 2 MOD, 4 MOD ... words
            later = active + step
            active = self._split(active, np.where(later < m, self.rank[np.minimum(later, m - 1)], -1))
            levels.append(self.rank.copy())
            step *= 2
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for level in range(len(levels) - 2, -1, -1):
            same = (a < m) & (b < m)
            same &= levels[level][np.minimum(a, m - 1)] == levels[level][np.minimum(b, m - 1)]
            common += np.where(same, MOD << level, 0)
            a, b = a + np.where(same, len(COVER) << level, 0), b + np.where(same, len(COVER) << level, 0)
        a, b = self.at[order[:-1]] + common, self.at[order[1:]] + common
        alive = np.arange(len(a))
        while len(alive):
            alive = alive[self.values[a[alive]] == self.values[b[alive]]]
            a[alive] += 1
            b[alive] += 1
            common[alive] += 1
        self.table = [common.astype(np.int32)]
        while 2 * (width := 1 << (len(self.table) - 1)) <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair i < j the number of equal values from i and from j on."""
        shift = (_FROM[(j - i) % MOD] - i) % MOD
        out, failed, k = shift.copy(), np.zeros(len(i), dtype=bool), 0
        todo = np.flatnonzero(shift > 0)
        while len(todo):
            same = self.values[i[todo] + k] == self.values[j[todo] + k]
            out[todo[~same]], failed[todo[~same]] = k, True
            k += 1
            todo = todo[same]
            todo = todo[shift[todo] > k]
        rest = np.flatnonzero(~failed)
        if len(rest):
            a, b = i[rest] + shift[rest], j[rest] + shift[rest]
            a, b = (self.rank[x // MOD * len(COVER) + _SLOT[x % MOD]] for x in (a, b))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for d in np.unique(level).tolist():
                of = np.flatnonzero(level == d)
                out[rest[of]] += np.minimum(self.table[d][low[of]], self.table[d][high[of] - (1 << d)])
        return out


def grids(starts: np.ndarray, sizes: np.ndarray, most: int = GRID):
    """(i, q) of all grid places of stretches of words, some ``most`` at a time."""
    document = np.repeat(np.arange(len(sizes)), sizes // 3)
    period = np.arange(len(document)) - np.repeat(np.cumsum(sizes // 3) - sizes // 3, sizes // 3) + 1
    step = np.maximum(SHORTEST, 3 * period) - period
    count = (sizes[document] - period) // step
    keep = count > 0
    document, period, step, count = document[keep], period[keep], step[keep], count[keep]
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        n = count[a:b]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        yield np.repeat(starts[document[a:b]], n) + nth * np.repeat(step[a:b], n) - 1, np.repeat(period[a:b], n)
        a = b


def find_runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the stretches of ``values``, by start, then period.

    Each stretch must be followed by a value that occurs nowhere else.
    """
    forward = backward = None
    found = [np.zeros((3, 0), dtype=np.int64)]
    for i, q in grids(starts, sizes):
        equal = values[i] == values[i + q]
        i, q = i[equal], q[equal]
        if not len(i):
            continue
        if forward is None:
            forward, backward = Extensions(values), Extensions(values[::-1])
        right = forward.right(i, i + q)
        left = backward.right(len(values) - i - q, len(values) - i)
        length = left + right + q
        keep = length >= np.maximum(SHORTEST, 3 * q)
        found.append(np.unique(np.stack([(i - left)[keep], length[keep], q[keep]]), axis=1))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch also has the multiples of its smallest period as periods
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def wrapped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by crc32 of its id, the words from some place on are replaced by repeats of the first ones there."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(documents: DataFrame, change=wrapped) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: the runs by start, then period, and the words that no run repeats.

    A word is left out of ``collapsed`` if any run holds it after that run's first period. ``change`` (doc_id, words) gives
    the words to look at.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                ids = part.column(0)
                texts = [change(d, (t or b"").split()) for d, t in zip(ids.to_pylist(), part.column(1).cast(pa.binary()).to_pylist())]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                starts = np.cumsum(sizes + 1) - sizes - 1
                coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
                values = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
                inside = np.ones(len(values), dtype=bool)
                inside[starts + sizes] = False
                values[inside] = coded.indices.to_numpy()
                values[~inside] = len(coded.dictionary) + np.arange(len(texts))
                start, length, period = find_runs(values, starts, sizes)
                drop = np.zeros(len(values) + 1, dtype=np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                kept = np.cumsum(drop[:-1]) == 0
                cuts = np.searchsorted(start, np.append(starts, len(values)))
                collapsed = []
                for t, a, n, runs in zip(texts, starts.tolist(), sizes.tolist(), np.diff(cuts).tolist()):
                    collapsed.append(b" ".join([t[k] for k in np.flatnonzero(kept[a : a + n]).tolist()] if runs else t))
                rows = pa.StructArray.from_arrays([pa.array(start - np.repeat(starts, np.diff(cuts))), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the greatest run, and digests of all runs and of the collapsed words."""
    rows = collapse(documents).withColumn("best", greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
