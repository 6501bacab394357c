"""SimHash near-duplicates at a similarity: fingerprints of five-word shingles compared in tiles, then exact sets.

Two texts are linked when the SimHash fingerprints of their sets of five-word shingles differ in ``radius`` (20) bits or fewer
and the Jaccard similarity of the sets is four fifths or more. A shingle counts once in a fingerprint however often the text
repeats it, so texts with equal sets have one fingerprint and links depend on sets alone. Texts of that similarity differ in 9.4 bits on
average with a deviation of 2.9, so the radius leaves out about one border pair in ten thousand (one in three hundred of sets of four), and
nearly all unrelated pairs are settled by an exclusive-or and a bit count.

No such link is missed for want of meeting: similar texts share one of the first ``n - ceil(0.8 n) + 1`` of their n
shingles in any fixed order, so these are the keys under which texts meet. The order puts shingles that are frequent
in a sample last (the sample decides how many texts meet, never which are linked). Of each key's texts all
are compared with the least first, as a join. What these links leave apart is compared in tiles of ``TILE_ROWS`` rows:
each text outside the first one's component with all others of the key, a task for each pair of tiles. So a group of
any size is spread over many tasks, and a group of true copies costs little more than its rows.

Pairs never leave a task. There a pair goes on if fingerprints, sizes and ``marks`` allow a link: marks are the parity of
the shingles in each of 512 cells, and they differ in no more cells than the sets differ in shingles, of which linked sets
of a and b shingles allow (a + b) / 9. Of such pairs a task returns a forest. The trees of all keys are put
together, and inside each resulting group, which a text is in once however many keys it shares, the sets themselves
are compared, again in tiles; a task returns one link for each two components that it joins. Both results are shorter than
what the tasks read.

Equal shingle sets are one node. Null text counts as empty; texts without words are copies of each other, texts of
less than five words are one shingle. Shingles are compared by 64-bit hashes. A null doc_id never names
a component, unless all of its rows have none. Of rows that repeat doc_id and text one stays, with its own other
columns, whatever those are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, unused
from .components import connected
from .simhash import LAST, SEED, TILE, bits_of, groups_of, shingle_hashes

WORDS, RADIUS, TILE_ROWS = 5, 20, 2048
#: Cells of the marks, and the shingles of a tile where whole sets are compared.
CELLS, TILE_SHINGLES = 512, 1 << 20
SAMPLE, FREQUENT = 20000, 1 << 18


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is four fifths or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def marks_of(s: np.ndarray) -> bytes:
    """For each of ``CELLS`` cells whether an odd number of the set's hashes falls into it."""
    return np.packbits((np.bincount(s & (CELLS - 1), minlength=CELLS) & 1).astype(np.uint8)).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _hashes(column: pa.Array) -> list[np.ndarray]:
    return [shingle_hashes((t or "").encode("utf-8", "replace"), WORDS) for t in column.to_pylist()]


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def frequent_shingles(documents: DataFrame, sample: int = SAMPLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` shingles that repeat most in about ``sample`` texts, sorted, and their counts."""
    total = max(documents.count(), 1)
    some = documents.where(F.pmod(F.xxhash64("text"), F.lit(total)) < sample).select("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(h) for h in _hashes(part.column(0))]))], names=["h"])

    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "h").limit(most).toArrow().sort_by("h")
    return rows["h"].to_numpy(), rows["n"].to_numpy()


def keyed(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, text_hash, node, size, fp, marks, keys) for each row; node is the hash of the shingle set, fp the fingerprint."""
    known, counts = frequent
    names = ["doc_id", "text_hash", "node", "size", "fp", "marks", "keys"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes = _hashes(part.column(2))
                sets, keys = [shingle_set(h) for h in hashes], []
                for s in sets:
                    n = len(s)
                    if len(known) and n:
                        where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[where] == s, counts[where], 0), kind="stable")]
                    keys.append(s[: n - (4 * n + 4) // 5 + 1])
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                fps = np.array([bits_of(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array(map(marks_of, sets), pa.binary()), _lists(keys)], names=names)

    return _columns(documents).mapInArrow(run, "doc_id long, text_hash long, node long, size long, fp long, marks binary, keys array<long>")


def tile_pairs(left: tuple, right: tuple, radius: int):
    """Places (i, j) in two sides (node, size, fp, part, marks) whose fingerprints, sizes and marks allow a link and whose parts differ.

    Both sides are sorted by bit count; pairs of tiles whose bit counts differ by more than the radius are skipped. A side with
    itself gives each pair once.
    """
    sides = []
    for node, size, fp, part, marks in (left, right):
        fp = fp.view(np.uint64)
        counts = np.bitwise_count(fp).astype(np.int16)
        order = np.argsort(counts, kind="stable")
        cells = np.frombuffer(b"".join(marks), dtype=np.uint64).reshape(len(marks), -1)
        sides.append((node[order], size[order], fp[order], part[order], cells[order], counts[order], order))
    (na, sa, fa, pa_, ma, ca, oa), (nb, sb, fb, pb, mb, cb, ob) = sides
    for a in range(0, len(na), TILE):
        last = min(a + TILE, len(na))
        for b in range(a if left is right else 0, len(nb), TILE):
            if cb[b] - ca[last - 1] > radius:
                break
            if ca[a] - cb[min(b + TILE, len(nb)) - 1] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(fa[a:last, None] ^ fb[None, b : b + TILE]) <= radius)
            i, j = i + a, j + b
            keep = (pa_[i] != pb[j]) & (5 * np.minimum(sa[i], sb[j]) >= 4 * np.maximum(sa[i], sb[j]))
            if left is right:
                keep &= i < j
            i, j = i[keep], j[keep]
            keep = 9 * np.bitwise_count(ma[i] ^ mb[j]).sum(axis=1, dtype=np.int64) <= sa[i] + sb[j]
            if keep.any():
                yield oa[i[keep]], ob[j[keep]]


def forest(left: tuple, right: tuple, radius: int, names: tuple, same=None):
    """Of the pairs of ``tile_pairs`` those that join two trees, as lists of nodes a and b.

    names are what the trees are made of, for each row of the sides; same(i, j), where given, decides whether a pair is linked.
    Pairs inside a tree are left out before that.
    """
    known, place = np.unique(np.concatenate(names), return_inverse=True)
    x, y = place[: len(names[0])], place[len(names[0]) :]
    tree = np.arange(len(known))
    a, b = [], []
    for i, j in tile_pairs(left, right, radius):
        apart = tree[x[i]] != tree[y[j]]
        for i, j in zip(i[apart].tolist(), j[apart].tolist()):
            one, other = tree[x[i]], tree[y[j]]
            if one != other and (same is None or same(i, j)):
                tree[tree == other] = one
                a.append(left[0][i])
                b.append(right[0][j])
    return a, b


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(radius: int):
    def run(batches):
        for _, (_, side, *columns) in groups_of(batches):
            one, other = (tuple(c[side == k] for c in columns) for k in (1, 0))
            if len(one[0]) and len(other[0]):
                yield _edges(*forest(one, other, radius, (one[0], other[0])))

    return run


def _linked(radius: int):
    def run(batches):
        for _, (_, tile, node, fp, part, hashes) in groups_of(batches):
            size, marks = np.array([len(h) for h in hashes]), np.array([marks_of(h) for h in hashes], dtype=object)
            low, high = tile == tile.min(), tile == tile.max()
            one = tuple(c[low] for c in (node, size, fp, part, marks))
            other = one if low.all() else tuple(c[high] for c in (node, size, fp, part, marks))
            x, y = hashes[low], hashes[high]
            yield _edges(*forest(one, other, radius, (one[3], other[3]), lambda i, j: alike(x[i], y[j])))  # noqa: B023  used at once

    return run


def _sets(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, hashes): the shingle sets of ``wanted`` (node, doc_id, text_hash); only their texts are read again."""

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(h) for h in _hashes(part.column(1))])], names=["node", "hashes"])

    texts = _columns(documents).join(wanted, ["doc_id", "text_hash"]).select("node", "text")
    return materialize(texts.mapInArrow(read, "node long, hashes array<long>"), "shingle-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """The pairs whose shingle sets are alike; only the texts of nodes in a pair are read again."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash"), "wanted-nodes")

    sets = _sets(wanted, documents)  # a row that repeats doc_id and text gives its pairs twice, which changes no component
    x, y = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "x"), ("b", "y")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x, y = part.column(2), part.column(3)
                yield part.select(["a", "b"]).filter(pa.array([alike(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(part.num_rows)], pa.bool_()))

    out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)
    discard(pairs, wanted, sets)
    return out


def _grouped(trees: DataFrame, nodes: DataFrame, parts: DataFrame, documents: DataFrame, radius: int) -> DataFrame:
    """Links between the parts inside the groups that ``trees`` connect, one for each two parts that a task joins."""
    found = connected(trees)
    groups = found.select("node", F.col("component").alias("group")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("group")).distinct())
    groups = nodes.join(groups, "node").join(parts, "node", "left").select("node", "size", "fp", "doc_id", "text_hash", "group", F.coalesce("component", "node").alias("part"))
    groups = materialize(groups, "near-groups")
    sets = _sets(groups.select("node", "doc_id", "text_hash"), documents)  # a row that repeats doc_id and text is there twice, in one part
    tiles = groups.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SHINGLES)).cast("int").alias("tiles"))
    tiles = materialize(tiles, "group-tiles")
    # each text lies in one tile of its group and goes to a task for each tile, its own included
    dealt = groups.join(tiles, "group").withColumn("tile", F.expr("CAST(pmod(xxhash64(node), tiles) AS INT)")).select("node", "group", "fp", "part", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("group", F.least("tile", "other"), F.greatest("tile", "other")).alias("task"), "tile", "node", "fp", "part")
    dealt = dealt.join(sets, "node").select("task", "tile", "node", "fp", "part", "hashes")
    out = materialize(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_linked(radius), "a long, b long"), "other-links")
    discard(groups, tiles)
    return out


def links(keyed_texts: DataFrame, documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``keyed_texts`` (from ``keyed``) exactly as all links would."""
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    # rows of one node have equal sets, and so equal sizes, fingerprints and keys
    nodes = keyed_texts.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("keys").alias("keys"), one)
    nodes = materialize(nodes.select("node", "size", "fp", "marks", "one.*", "keys"), "shingle-nodes")
    discard(keyed_texts)
    every, light = nodes.select(F.explode("keys").alias("key"), "node"), nodes.select("node", "size", "fp")
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("key", "least"), "shared-keys")
    met = materialize(every.join(shared, "key"), "met-keys")
    discard(shared)
    stars = materialize(met.where("node != least").select("node", "least").distinct(), "star-pairs")
    other = light.select(F.col("node").alias("least"), F.col("size").alias("least_size"), F.col("fp").alias("least_fp"))
    near = F.expr(f"bit_count(fp ^ least_fp) <= {radius} AND 5 * least(size, least_size) >= 4 * greatest(size, least_size)")
    first = _verified(stars.join(light, "node").join(other, "least").where(near).select(F.col("least").alias("a"), F.col("node").alias("b")), nodes, documents, "first-links")
    discard(stars)
    parts = materialize(connected(first), "first-parts")
    named = met.join(parts, "node", "left").select("key", "node", "least", F.coalesce("component", "node").alias("part"))
    named = materialize(named, "named-nodes")
    # a key is open while its nodes are in two components or more, and more than the one pair that was compared
    lead = F.max(F.when(F.col("node") == F.col("least"), F.col("part"))).alias("lead")
    open_keys = named.groupBy("key").agg(F.count("*").alias("n"), lead, F.min("part").alias("low"), F.max("part").alias("high")).where("n > 2 AND low < high")
    open_keys = materialize(open_keys.select("key", "lead"), "open-keys")
    opened = named.join(open_keys, "key").select("key", "node", "part", (F.col("part") != F.col("lead")).alias("outside"))
    opened = materialize(opened.join(nodes.select("node", "size", "fp", "marks"), "node"), "open-nodes")
    tiles = opened.groupBy("key").agg(F.count("*").alias("n"), F.count_if("outside").alias("m"))
    tiles = materialize(tiles.select("key", *(F.ceil(F.col(c) / TILE_ROWS).cast("int").alias(t) for c, t in (("n", "rows"), ("m", "columns")))), "tiles")
    dealt = opened.join(tiles, "key").withColumn("own", F.xxhash64("node"))
    # each text lies in one tile of the key's rows and, if outside, in one of its columns: it goes to all tasks of that tile
    sides = (
        dealt.select("key", F.lit(0).alias("side"), "node", "size", "fp", "part", "marks", F.pmod("own", "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column")),
        dealt.where("outside").select("key", F.lit(1).alias("side"), "node", "size", "fp", "part", "marks", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod("own", "columns").alias("column")),
    )
    dealt = sides[0].unionByName(sides[1]).select(F.xxhash64("key", "row", "column").alias("task"), "side", "node", "size", "fp", "part", "marks")
    trees = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_compared(radius), "a long, b long")
    trees = materialize(trees, "near-trees")
    others = _grouped(trees, nodes, parts, documents, radius)
    out = materialize(first.unionByName(others), "links")
    discard(nodes, met, first, parts, named, open_keys, opened, tiles, trees, others)
    return out


def components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for each row; root is the component's least node, component_id its least doc_id."""
    docs = materialize(keyed(documents, frequent_shingles(documents)), "keyed-texts")
    light = materialize(docs.select("doc_id", "text_hash", "node"), "text-nodes")
    found = links(docs, documents, radius)
    roots = connected(found)
    firsts = materialize(light.groupBy("node").agg(F.min("doc_id").alias("first")), "first-ids")
    rooted = materialize(firsts.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = materialize(rooted.join(least, "root").select("node", "root", "component_id"), "named")
    out = materialize(light.join(named, "node").select("doc_id", "text_hash", "root", "component_id"), "members")
    discard(light, found, firsts, rooted, least, named)
    return out


def keep_first(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the one with the least doc_id (all columns); of rows that repeat it, one."""
    i, h = unused(documents.columns, "id", "hash")
    found = components(documents, radius)
    rows = found.where("doc_id = component_id").groupBy("doc_id", "root", "text_hash").agg(F.count("*").alias("n"))
    keep = rows.groupBy(F.col("doc_id").alias(i), "root").agg(F.min(F.struct("text_hash", "n")).alias("one"))
    keep = materialize(keep.select(i, F.col("one.text_hash").alias(h), F.col("one.n").alias("n")), "kept")
    discard(found)
    marked = documents.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64("text")})
    alone = marked.join(keep.where("n = 1"), [i, h], "left_semi")
    again = keep.where("n > 1")
    if not again.isEmpty():  # only rows that repeat doc_id and text are shuffled to leave one of each
        alone = alone.unionByName(marked.join(again, [i, h], "left_semi").dropDuplicates([i, h]))
    return alone.select(*documents.columns)
