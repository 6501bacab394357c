"""Exact substring deduplication: bytes of strings of 200 bytes that start elsewhere too are removed.

1. Anchors. In each window of 200 bytes the 48-byte gram of least hash is its anchor, so equal windows
   have equal anchors at the same place: one position in 65 is enough to find every repeat.
2. Anchors whose whole surroundings (all windows that they stand for) occur again are repeats as they
   are: those of equal gram hash and equal BLAKE2 digest of all their bytes. Of the others, those whose gram occurs
   elsewhere are compared exactly.
3. Suffix sort. Inside each group of equal grams the suffixes to the right, and the reversed texts to
   the left, are sorted by mergesort. Prefix polynomial hashes and binary search give the common
   extension of two suffixes, so a comparison takes a logarithmic number of steps. The extensions
   of neighbours in sorted order are checked against the bytes; a group in which a hash misled is
   sorted by its bytes. Windows that share their right class and their left class are equal.
4. Groups of more than ``most`` different surroundings would be too much for one task's sort: their windows are
   counted in Spark by BLAKE2 digests of their bytes, in blocks of forty, then of eight and of two where those differ, then one
   by one. Both ways find the same windows. No byte is removed because a polynomial hash alone was equal.

Null text counts as empty. Rows that repeat are texts of their own, so both lose what they share.
Texts shorter than ``length`` lose nothing. Matches never cross texts. A null doc_id is a value like
any other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, slices, unused

GRAM = 48
#: Texts are cut into stretches of so many bytes where anchors' surroundings are taken out of them.
STRETCH = 1 << 20
#: Bytes whose hashes are held at once while anchors are picked: about a hundred bytes of arrays for each.
PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_KEY = ["doc_id", "text_hash"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def digest(data: bytes) -> int:
    """BLAKE2b of some bytes as a signed long: a check that is independent of the polynomial hashes."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Hashed:
    """Prefix polynomial hashes of a buffer: the hash of any part in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:-1], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def anchors(hashed: Hashed, valid: np.ndarray, length: int) -> np.ndarray:
    """Positions picked by the content: in each window of ``length`` bytes starting at ``valid``, the gram of least hash."""
    size = len(hashed.data)
    n, w = size - GRAM + 1, length - GRAM + 1
    place = np.uint64((1 << 24) - 1)
    grams = mix(hashed.of(np.arange(n), np.arange(GRAM, size + 1)))
    value = (grams & ~place) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = value
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[valid], ahead[valid + w - 1])
    return np.unique(least & place).astype(np.int64)


def _pieces(texts: list[bytes], length: int, most: int = PIECE):
    """(row, offset, piece) of texts; longer ones are cut with an overlap that keeps every window whole."""
    for row, t in enumerate(texts):
        if len(t) >= length:
            for at in range(0, len(t) - length + 1, most):
                yield row, at, t[at : at + most + length - 1]


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, most=PIECE):
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(2).to_pylist()]
                buffer, held = [], 0
                for piece in [*_pieces(texts, length), None]:
                    if piece is None or held + len(piece[2]) > 2 * PIECE:
                        if buffer:
                            yield _anchor_batch(buffer, texts, part, length)
                        buffer, held = [], 0
                    if piece is not None:
                        buffer.append(piece)
                        held += len(piece[2])

    return run


def _anchor_batch(buffer, texts, part, length):
    sizes = np.array([len(b[2]) for b in buffer])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    hashed = Hashed(np.frombuffer(b"".join(b[2] for b in buffer), dtype=np.uint8))
    valid = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(starts, sizes)])
    at = anchors(hashed, valid, length)
    which = np.searchsorted(starts, at, side="right") - 1
    rows = np.array([b[0] for b in buffer])[which]
    q = at - starts[which] + np.array([b[1] for b in buffer])[which]
    total = np.array([len(t) for t in texts])[rows]
    left, right = np.minimum(q, length - GRAM), np.minimum(total - q, length)
    around = (texts[r][i:j] for r, i, j in zip(rows.tolist(), (q - left).tolist(), (q + right).tolist()))
    f = np.fromiter(map(digest, around), np.int64, len(q)) + left * 1000003 + right * 7919
    m = hashed.of(at, at + GRAM)
    ids = part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*ids, pa.array(q.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), pa.array(m.view(np.int64)), pa.array(f)], names=[*_KEY, "q", "lhs", "rhs", "m", "f"])


# --- suffix sort ---------------------------------------------------------------------------------


def common(hashed: Hashed, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, ``most`` at most, by binary search over hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = hashed.of(a, a + mid) == hashed.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def _less(hashed: Hashed, a, na, b, nb) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a is less than suffix b, and whether they are equal; na and nb are their lengths."""
    n = common(hashed, a, b, np.minimum(na, nb))
    last = len(hashed.data) - 1
    ended_a, ended_b = n == na, n == nb
    ca, cb = hashed.data[np.minimum(a + n, last)], hashed.data[np.minimum(b + n, last)]
    return np.where(ended_a, ~ended_b, ~ended_b & (ca < cb)), ended_a & ended_b


def suffix_sort(hashed: Hashed, start: np.ndarray, size: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside their groups: mergesort from runs of one, all runs of all groups at a time.

    first and end are the bounds of each item's group; groups lie one after another.
    """
    order = np.arange(len(start))
    width, most = 1, int((end - first).max()) if len(start) else 0
    while width < most:
        place = np.arange(len(order))
        local = place - first
        run = local // width
        other = first + (run ^ 1) * width
        stop = np.minimum(other + width, end)
        go = np.flatnonzero(other < end)
        low, high = other[go].copy(), stop[go].copy()
        item, left_run = order[go], (run[go] & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            mine, theirs = item[open_], order[mid]
            less, same = _less(hashed, start[theirs], size[theirs], start[mine], size[mine])
            before = less | (same & ~left_run[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = place.copy()
        pair = first[go] + (run[go] & ~1) * width
        target[go] = pair + (local[go] - run[go] * width) + (low - other[go])
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def classes(hashed: Hashed, start, size, first, end) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's common prefix with the one before in its group (-1 for the first).

    The common prefixes are checked on the bytes; where a hash misled, the group is sorted by its bytes.
    """
    order = suffix_sort(hashed, start, size, first, end)
    lcp = np.full(len(order), -1, dtype=np.int64)
    inner = np.flatnonzero(np.arange(len(order)) != first)
    last = len(hashed.data) - 1
    for at in range(0, len(inner), 4096):
        i = inner[at : at + 4096]
        a, b = order[i - 1], order[i]
        most = np.minimum(size[a], size[b])
        claimed = common(hashed, start[a], start[b], most)
        step = np.arange(int(most.max()) if len(most) else 0)
        equal = hashed.data[np.minimum(start[a][:, None] + step, last)] == hashed.data[np.minimum(start[b][:, None] + step, last)]
        equal |= step >= most[:, None]
        true = np.where(equal.all(axis=1), most, equal.argmin(axis=1)) if len(step) else most
        lcp[i] = true
        for g in np.unique(first[i[true != claimed]]):
            members = np.arange(g, end[g])
            text = {k: hashed.data[start[k] : start[k] + size[k]].tobytes() for k in members.tolist()}
            order[members] = sorted(members.tolist(), key=text.get)
            for x, y in zip(members, members[1:]):
                s, t = text[order[x]], text[order[y]]
                lcp[y] = next((k for k, (c, d) in enumerate(zip(s, t)) if c != d), min(len(s), len(t)))
    return order, lcp


def repeats(contexts: list[bytes], left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with their surroundings, sorted by group: bytes before and after each anchor that repeated windows cover.

    (0, 0) where no window of the anchor occurs again in its group.
    """
    n = len(contexts)
    sizes = left + right
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    joined = b"".join(contexts)
    data = np.frombuffer(joined, dtype=np.uint8)
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(cuts, np.diff(np.append(cuts, n)))
    end = np.repeat(np.append(cuts[1:], n), np.diff(np.append(cuts, n)))
    forward = Hashed(data)
    right_order, right_lcp = classes(forward, starts + left, right, first, end)
    backward = Hashed(data[::-1].copy())
    left_order, left_lcp = classes(backward, len(data) - (starts + left), left, first, end)
    far, near = np.full(n, -1, dtype=np.int64), np.full(n, length + 1, dtype=np.int64)
    right_class, left_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(length - GRAM + 1):  # windows that start d bytes before the anchor
        fit = np.flatnonzero((left >= d) & (right >= length - d))
        if len(fit) < 2:
            continue
        right_class[right_order] = np.cumsum(right_lcp < length - d)
        left_class[left_order] = np.cumsum(left_lcp < d)
        key = right_class[fit] * np.int64(n + 1) + left_class[fit]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = key[1:] == key[:-1]
        hit = fit[by[np.append(same, False) | np.append(False, same)]]
        far[hit] = d
        near[hit] = np.minimum(near[hit], d)
    found = far >= 0
    return np.where(found, far, 0), np.where(found, length - near, 0)


def _sorter(length: int, block: int = 2048):
    names = [*_KEY, "start", "end"]

    def work(rows):
        left, right = rows["lhs"].astype(np.int64), rows["rhs"].astype(np.int64)
        before, after = repeats(list(rows["context"]), left, right, rows["m"], length)
        out = np.flatnonzero((rows["k"] == 1) & (before + after > 0))
        q = rows["q"].astype(np.int64)[out]
        return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"][out]), pa.array(rows["text_hash"][out]), pa.array((q - before[out]).astype(np.int32)), pa.array((q + after[out]).astype(np.int32))], names=names)

    def run(batches):
        rest = None
        for batch in batches:
            rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            if rest is not None:
                rows = {n: np.concatenate((rest[n], rows[n])) for n in rows}
            while len(rows["m"]) > block:
                cuts = np.flatnonzero(rows["m"][1:] != rows["m"][:-1]) + 1
                cut = cuts[np.maximum(np.searchsorted(cuts, block, side="right") - 1, 0)] if len(cuts) else 0
                if not cut:
                    break
                yield work({n: c[:cut] for n, c in rows.items()})
                rows = {n: c[cut:] for n, c in rows.items()}
            rest = rows
        if rest is not None and len(rest["m"]):
            yield work(rest)

    return run


# --- large groups --------------------------------------------------------------------------------


def _blocks(length: int, size: int, windows: bool):
    """For each anchor and block of ``size`` windows inside the row's range: hashes of the block's common core, of all its bytes, and of each window."""

    def run(batches):
        for batch in batches:
            rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            left, right = rows["lhs"].astype(np.int64), rows["rhs"].astype(np.int64)
            first, last = rows["first"].astype(np.int64), rows["last"].astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(left + right)[:-1])) + left
            data = b"".join(rows["context"])
            hashed = Hashed(np.frombuffer(data, dtype=np.uint8))
            for d0 in range(0, length - GRAM + 1, size):
                d1 = min(d0 + size - 1, length - GRAM)
                low, high = np.maximum(d0, length - right), np.minimum(d1, left)
                i = np.flatnonzero((low <= high) & (first <= d0) & (d1 <= last))
                if not len(i):
                    continue
                s, low, high = starts[i], low[i], high[i]
                with np.errstate(over="ignore"):
                    core = mix(hashed.of(s - d0, s + length - d1)) + np.uint64(d0)
                # equal cores only bring blocks together; what is equal is decided by the digests
                whole = np.fromiter((digest(data[a:b]) for a, b in zip((s - high).tolist(), (s + length - low).tolist())), np.int64, len(i)) + low * 7919 + high
                columns = [pa.array(rows[n][i]) for n in (*_KEY, "q", "k")]
                columns += [pa.array(np.full(len(i), d0, dtype=np.int16)), pa.array(np.full(len(i), d1, dtype=np.int16)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(whole)]
                if windows:
                    n = high - low + 1
                    d = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                    window = np.fromiter((digest(data[a : a + length]) for a in (np.repeat(s, n) - d).tolist()), np.int64, len(d))
                    columns.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(window)))
                yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "q", "k", "first", "last", "low", "high", "core", "whole", *(["windows"] if windows else [])])

    return run


def _large_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of anchors in large groups, by blocks of 40, of 8 and of 2, then single windows.

    A block whose bytes all occur again is repeated as it is; only blocks that share their core but differ go on.
    """
    schema = "doc_id long, text_hash long, q int, k long, first short, last short, low short, high short, core long, whole long"
    rows = contexts.withColumns({"first": F.lit(0).cast("short"), "last": F.lit(length).cast("short")})
    found = []
    for size, windows in ((40, False), (8, False), (2, True)):
        blocks = materialize(rows.mapInArrow(_blocks(length, size, windows), schema + ", windows array<long>" * windows), "blocks")
        one = F.struct(*_KEY, "q", "first", "last", "low", "high")
        kinds = blocks.groupBy("core", "whole").agg(F.sum("k").alias("n"), F.min(one).alias("one"), *([F.max("windows").alias("windows")] if windows else []))
        kinds = materialize(kinds, "block-kinds")
        again = materialize(kinds.where("n > 1").select("core", "whole"), "blocks-again")
        found.append(blocks.where("k = 1").join(again, ["core", "whole"]).select(*_KEY, F.expr("q - high").alias("start"), F.expr(f"q + {length} - low").alias("end")))
        mixed = materialize(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"), "mixed-cores")
        left = kinds.join(mixed, "core")
        if not windows:
            left = materialize(left.select("one.*", F.col("n").alias("k")).select(*_KEY, "q", "k", "first", "last"), "blocks-left")
            rows = contexts.drop("k").join(left, [*_KEY, "q"]).select(*contexts.columns, "first", "last")
    # the place d in the key keeps two anchors of one text from meeting in one and the same window
    single = left.select("core", "n", "one", F.posexplode("windows").alias("i", "window"))
    single = materialize(single.select("core", "n", "one.*", F.expr("one.low + i").alias("d"), "window"), "windows")
    twice = materialize(single.groupBy("core", "d", "window").agg(F.count("*").alias("times")).where("times > 1").select("core", "d", "window"), "windows-again")
    found.append(single.where("n = 1").join(twice, ["core", "d", "window"]).select(*_KEY, F.expr("q - d").alias("start"), F.expr(f"q - d + {length}").alias("end")))
    return reduce(DataFrame.unionByName, found)


# --- the operator --------------------------------------------------------------------------------


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, stretch, at, data): each text's bytes in stretches of ``STRETCH``, with ``length`` bytes more on both sides."""
    cut = docs.select(*_KEY, F.encode("text", "utf-8").alias("data"))
    cut = cut.select(*_KEY, "data", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(octet_length(data) DIV {STRETCH} AS INT)"))).alias("stretch"))
    at = F.greatest(F.col("stretch") * STRETCH - length, F.lit(0))
    return cut.select(*_KEY, "stretch", at.alias("at"), F.substring("data", at + 1, F.lit(STRETCH + 2 * length)).alias("data"))


def _contexts(most: int = 8 << 20):
    names = [*_KEY, "q", "lhs", "rhs", "m", "k", "large", "context"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    def run(batches):
        out, held = [], 0
        for batch in batches:
            for doc_id, text_hash, at, data, items in zip(*batch.columns):
                doc_id, text_hash, at, data = (x.as_py() for x in (doc_id, text_hash, at, data))
                for it in items.as_py():
                    q, lhs, rhs = it["q"], it["lhs"], it["rhs"]
                    out.append((doc_id, text_hash, q, lhs, rhs, it["m"], it["k"], it["large"], data[q - at - lhs : q - at + rhs]))
                    held += lhs + rhs
                    if held > most:
                        yield packed(out)
                        out, held = [], 0
        yield packed(out)

    return run


def spans(documents: DataFrame, length: int = 200, most: int = 500) -> DataFrame:
    """(doc_id, text_hash, spans): spans is an array of (start, end) byte ranges to remove, which may overlap.

    A null doc_id stands as the largest long.
    """
    docs = _texts(documents)
    found = materialize(docs.mapInArrow(_anchor_rows(length), "doc_id long, text_hash long, q int, lhs short, rhs short, m long, f long"), "anchors")
    grams = materialize(found.groupBy("m").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).where("n > 1").select("m", F.expr("a != b").alias("mixed")), "grams")
    repeated = materialize(found.join(grams, "m"), "repeated")
    discard(found, grams)
    kinds = materialize(repeated.where("mixed").groupBy("m", "f").agg(F.count("*").alias("k"), F.min(F.struct(*_KEY, "q", "lhs", "rhs")).alias("one")), "kinds")
    sizes = materialize(kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.min("k").alias("least")).where("least = 1").select("m", F.expr(f"kinds > {most}").alias("large")), "gram-sizes")
    chosen = materialize(kinds.join(sizes, "m").select("one.*", "m", "k", "large"), "compared")
    stretch = F.expr(f"q DIV {STRETCH}").cast("int").alias("stretch")
    parts = chosen.groupBy(*_KEY, stretch).agg(F.collect_list(F.struct("q", "lhs", "rhs", "m", "k", "large")).alias("items"))
    schema = "doc_id long, text_hash long, q int, lhs short, rhs short, m long, k long, large boolean, context binary"
    contexts = materialize(_stretches(docs, length).join(parts, [*_KEY, "stretch"]).select(*_KEY, "at", "data", "items").mapInArrow(_contexts(), schema), "contexts")
    small = contexts.where("not large").drop("large").repartition("m").sortWithinPartitions("m").mapInArrow(_sorter(length), "doc_id long, text_hash long, start int, end int")
    part = small.unionByName(_large_groups(contexts.where("large"), length))
    # text by text: the repeated anchors without those that were compared singly
    every = repeated.groupBy(*_KEY).agg(F.collect_list("q").alias("every"), F.max(F.expr("q + rhs")).alias("last"))
    single = chosen.where("k = 1").groupBy(*_KEY).agg(F.collect_list("q").alias("single"))
    left = F.array_except("every", F.coalesce("single", F.array().cast("array<int>")))
    # rhs is ``length`` or what is left of the text, and then last is the text's end
    around = F.transform(left, lambda q: F.struct(F.greatest(q - (length - GRAM), F.lit(0)).alias("start"), F.least(q + length, "last").alias("end")))
    whole = every.join(single, _KEY, "left").select(*_KEY, around.alias("spans"))
    part = part.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = whole.unionByName(part).groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = materialize(out.where("size(spans) > 0"), "spans")
    discard(repeated, kinds, sizes, chosen, contexts)
    return out


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))


def merge(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in found or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept)


def to_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they cut in two."""
    out = []
    for start, end in runs:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def digests(documents: DataFrame, length: int = 200) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    found = spans(documents, length)
    release(documents.sparkSession)
    rows = _texts(documents).join(found, _KEY, "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                out = []
                for text, got in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data, runs = text.encode("utf-8", "replace"), merge(got)
                    out.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(cut(data, runs)).hexdigest()))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {(1 << 63) - 1}L)"))


def remove(documents: DataFrame, length: int = 200) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``; a character that a span cuts in two stays.

    n_chars, where there is one, is counted anew. Rows stay, whatever is left of their texts.
    """
    i, h, c = unused(documents.columns, "id", "hash", "cuts")
    found = spans(documents, length).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(c))
    release(documents.sparkSession)
    marked = documents.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), h: F.xxhash64("text")})
    rows = marked.join(found, [i, h], "left").select(*documents.columns, c)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                texts = []
                for text, got in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    if text is not None and got:
                        data = text.encode("utf-8", "replace")
                        text = cut(data, to_characters(data, merge(got))).decode("utf-8")
                    texts.append(text)
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    out = rows.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
