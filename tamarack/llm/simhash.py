"""SimHash near-duplicates: exact comparison of fingerprints in tiles, by exclusive-or and bit counts.

Fingerprints of 64 bits link at ``radius`` (2) or fewer differing bits. They are dealt out by the bits
they agree on: of four blocks of 16 bits two at least are equal in any linked pair, so each distinct
fingerprint goes to six buckets keyed by two blocks, and no link is lost. A bucket's fingerprints are
sorted by bit count and compared tile by tile; pairs of tiles whose bit counts differ by more than the
radius are skipped. Buckets of more than ``most`` fingerprints are dealt once more by two of four
equal blocks of the other 32 bits, which leaves 16 free bits and so 65536 fingerprints at most.

Equal texts share a fingerprint and meet only once. Null text counts as empty: no words, fingerprint
zero, linked like any other. Repeated rows are in the same component. A null doc_id never names a
component, unless all of its rows have none (then null). Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected

SEED, TILE = 42, 256
LAST = (1 << 63) - 1


def shingle_hashes(data: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a text in UTF-8, repeats included; fewer words than ``size`` are one shingle."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    k = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - k], ends[k:])], dtype="<u8")


def bits_of(hashes: np.ndarray) -> int:
    """Unsigned SimHash of hashes: the bits that are set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << j for j in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def fingerprint(data: bytes, size: int = 3) -> int:
    """Unsigned SimHash of a text in UTF-8 over its word shingles, repeats included."""
    return bits_of(shingle_hashes(data, size))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) for each row; fp is the fingerprint as a signed long."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches):
        for batch in batches:
            got = [fingerprint((t or "").encode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, dtype=np.uint64).view(np.int64)), batch.column(1)], names=["doc_id", "fp", "text_hash"])

    return columns.mapInArrow(run, "doc_id long, fp long, text_hash long")


def links_in(group: np.ndarray, radius: int) -> np.ndarray:
    """For distinct unsigned fingerprints, the index of the first one of each one's component inside the group."""
    counts = np.bitwise_count(group).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    group, counts = group[order], counts[order]
    left, right = [], []
    for a in range(0, len(group), TILE):
        for b in range(a, len(group), TILE):
            if counts[b] - counts[min(a + TILE, len(group)) - 1] > radius:
                break
            near = np.bitwise_count(group[a : a + TILE, None] ^ group[None, b : b + TILE]) <= radius
            i, j = np.nonzero(near)
            keep = i + a < j + b
            left.append(i[keep] + a)
            right.append(j[keep] + b)
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(group))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    out = np.empty(len(group), dtype=np.int64)
    out[order] = order[label]
    return out


def groups_of(batches, key: int = 0):
    """Consecutive rows with the same key as (key, list of columns); batches are sorted by the key."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        keys = columns[key]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()) if len(cuts) else []:
            yield keys[a], [c[a:b] for c in columns]
        last = int(cuts[-1]) if len(cuts) else 0
        rest = [c[last:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest[key][0], rest


def _forest(radius: int):
    def run(batches):
        a, b = [], []
        for _, (_, fps) in groups_of(batches):
            label = links_in(fps.view(np.uint64), radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            a.append(fps[moved])
            b.append(fps[label[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _keyed(rows: DataFrame, width: int, base: str) -> DataFrame:
    """Six rows of each: two of the four blocks of ``width`` bits of ``rest`` are appended to the key ``base``."""
    parts = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        mask = (1 << width) - 1
        blocks = [f"(shiftrightunsigned(rest, {k * width}) & {mask}L)" for k in (i, j)]
        parts.append(f"shiftleft(shiftleft({base}, 3) + {n}L, {2 * width}) + shiftleft({blocks[0]}, {width}) + {blocks[1]}")
    return rows.select("fp", "rest", F.explode(F.expr(f"array({', '.join(parts)})")).alias("key"))


def _tiles(keyed: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    rows = keyed.select("key", "fp").join(sizes.select("key"), "key")
    return rows.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_forest(radius), "a long, b long")


def links(distinct: DataFrame, radius: int = 2, most: int = 512) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as all links would."""
    keyed = materialize(_keyed(distinct.select("fp", F.col("fp").alias("rest")), 16, "0L"), "simhash-keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    edges = _tiles(keyed, sizes.where(f"n <= {most}"), radius)
    large = sizes.where(f"n > {most}")
    # the two blocks that the key doesn't hold, side by side
    others = [[k for k in range(4) if k not in pair] for pair in combinations(range(4), 2)]
    free = [f"(shiftrightunsigned(fp, {16 * i}) & 65535L) + shiftleft(shiftrightunsigned(fp, {16 * j}) & 65535L, 16)" for i, j in others]
    combo = "CAST(shiftright(key, 32) & 7L AS INT)"
    hot = keyed.join(large.select("key"), "key").select("fp", F.col("key").alias("first"), F.expr(f"element_at(array({', '.join(free)}), {combo} + 1)").alias("rest"))
    again = _keyed(hot, 8, "first").select("fp", "key")
    deeper = again.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_forest(radius), "a long, b long")
    return edges.unionByName(deeper)


def components(documents: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row; root is the component's least fingerprint, component_id is the least doc_id reachable by links."""
    docs = materialize(fingerprints(documents), "fingerprints")
    firsts = docs.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
    distinct = materialize(firsts, "distinct-fingerprints")
    roots = connected(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    discard(distinct, rooted, least)
    return docs.join(named, "fp").select("doc_id", "text_hash", "fp", "root", F.expr(f"nullif(component_id, {LAST}L)").alias("component_id"))


def near_duplicates(documents: DataFrame, radius: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    rows = components(documents, radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
