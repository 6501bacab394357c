"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact where they can't decide.

Vectors link when their labels are equal and their cosine in double precision is ``threshold`` or more. Equal
vectors are compared once and counted as often as they occur. Each label's vectors are dealt into
tiles along the principal directions of a bounded sample; the tiles' boxes in those directions bound the
distance of unit vectors from below, so tile pairs that can't hold a link are skipped without loss, and of the others
only vectors that come near enough to the other tile's box take part. A vector is sent once for each tile that it
has to meet, so tiles hold many rows (``TILE``, fewer of vectors so long that a tile would outgrow ``NUMBERS`` components);
inside a task both sides are ordered along the tree and parts of ``PART`` rows are skipped by their own boxes. Every
vector is quantised to int8 with a scale of its own; the norm of what quantising took away bounds the error of
each product, and only pairs whose bound reaches the threshold are computed in double precision. Links are counted
and their components joined part by part, so a tile of near copies never holds all its pairs at once.

A vector that is null, zero, or holds null or non-finite components, or whose label is null, links with nothing:
no links, component of its own. Vectors of different length never link. Repeated rows link with each
other. A null vec_id counts as the largest long and comes back as null. A vec_id is taken to name one
vector: rows that share one but differ share a component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, materialize
from .components import connected
from .simhash import groups_of

DIRECTIONS, DEPTH = 8, 12
TILE, PART, NUMBERS = 4096, 256, 1 << 22
LAST = (1 << 63) - 1


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors and norms of the errors, both rounded up."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(decoded, axis=1) * up, np.linalg.norm(unit - decoded, axis=1) * up + 1e-12


def quantised(unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit vectors in double precision with what ``linked`` needs of them, so that each is quantised once."""
    codes, scale, norm, error = quantise(unit)
    # products of int8 codes are whole numbers that single precision holds exactly up to 2**24
    kind = np.float32 if unit.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return unit, codes.astype(kind), scale, norm, error


def linked(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float, chunk: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sides of ``quantised`` vectors whose product in double precision reaches the threshold."""
    (a, qa, sa, na, ea), (b, qb, sb, _, eb) = a, b
    near = (qa @ qb.T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = na[:, None] * eb[None, :] + ea[:, None] * (1 + 1e-9)
    i, j = np.nonzero(near + bound >= threshold - 1e-9)
    keep = [np.einsum("ij,ij->i", a[i[k : k + chunk]], b[j[k : k + chunk]]) >= threshold for k in range(0, len(i), chunk)]
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def part_links(unit: np.ndarray, left: np.ndarray, right: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float, part: int = PART):
    """Linked pairs of the rows ``left`` and ``right`` (or of ``left`` with itself, each once), a part of ``left`` at a time.

    Both are ordered along the tree; parts whose boxes lie too far apart are not multiplied.
    """
    directions, cuts = model
    x = unit @ directions if unit.shape[1] == directions.shape[0] else np.zeros((len(unit), 1))
    path, same, sides = paths(x, cuts), left is right, quantised(unit)
    left = left[np.argsort(path[left], kind="stable")]
    right = left if same else right[np.argsort(path[right], kind="stable")]
    place = np.zeros(len(unit), dtype=np.int64)
    place[right] = np.arange(len(right))
    starts = np.arange(0, len(right), part)
    low, high = np.minimum.reduceat(x[right], starts), np.maximum.reduceat(x[right], starts)
    for n, start in enumerate(range(0, len(left), part)):
        rows = left[start : start + part]
        gap = np.maximum(0, np.maximum(low - x[rows].max(axis=0), x[rows].min(axis=0) - high))
        meet = (gap**2).sum(axis=1) <= 2 - 2 * threshold + 1e-6
        if same:
            meet[:n] = False
        columns = right[np.repeat(meet, part)[: len(right)]]
        if len(columns):
            i, j = linked(tuple(c[rows] for c in sides), tuple(c[columns] for c in sides), threshold)
            i, j = rows[i], columns[j]
            if same:
                ahead = place[i] < place[j]
                i, j = i[ahead], j[ahead]
            yield i, j


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each row's component, after the edges (i, j) have joined components."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
        if not len(i):
            return root
        least, root = np.minimum(i, j), root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        while (root != root[root]).any():
            root = root[root]


def _matrix(column: np.ndarray) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def basis(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions of most variance in the sample, and the cuts of a tree that halves it along them in turn."""
    directions = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][:DIRECTIONS].T
    x = sample @ directions
    cuts = np.zeros(1 << DEPTH)
    node = np.ones(len(x), dtype=np.int64)
    for level in range(DEPTH):
        axis = x[:, level % x.shape[1]]
        for n in np.unique(node):
            cuts[n] = np.median(axis[node == n])
        node = node * 2 + (axis > cuts[node])
    return directions, cuts


def paths(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each projected vector as DEPTH bits; nodes that the sample didn't reach are cut at 0."""
    node = np.ones(len(x), dtype=np.int64)
    for level in range(DEPTH):
        node = node * 2 + (x[:, level % x.shape[1]] > cuts[node])
    return node - (1 << DEPTH)


def _projected(model):
    def run(batches):
        directions, cuts = model.value if model is not None else (None, None)
        for batch in batches:
            vectors = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.zeros((len(vectors), DIRECTIONS))
            path = np.zeros(len(vectors), dtype=np.int64)
            if directions is not None:
                fit = np.flatnonzero([len(v) == directions.shape[0] for v in vectors])
                if len(fit):
                    own = _matrix(vectors[fit]) @ directions
                    x[fit, : own.shape[1]] = own
                    path[fit] = paths(own, cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path), pa.array(list(x), pa.list_(pa.float64()))], names=[*batch.schema.names, "path", "x"])

    return run


def _tile_links(threshold: float, model):
    def run(batches):
        for _, (_, side, rep, weight, vector) in groups_of(batches):
            unit = _matrix(vector)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
            if side[0] == 2:
                right = left
            if not len(left) or not len(right):
                continue
            count, root = np.zeros(len(rep)), np.arange(len(rep))
            for i, j in part_links(unit, left, right, model.value, threshold):
                count += np.bincount(i, weights=weight[j], minlength=len(rep)) + np.bincount(j, weights=weight[i], minlength=len(rep))
                root = joined(root, i, j)
            out = np.flatnonzero(count > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(count[out].astype(np.int64)), pa.array(rep[root[out]])], names=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, sample: int = 4096) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept. The directions are fitted on ``sample`` vectors at most."""
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec_id"), F.col("label"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.0).alias("vector"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable")
    reps = materialize(good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")
    some = [r.vector for r in hash_sample(reps.select("rep", "vector"), "rep", sample).collect()]
    model = None
    if some:
        size = max({len(v) for v in some}, key=lambda n: (sum(len(v) == n for v in some), n))
        fit = np.array([v for v in some if len(v) == size])
        model = spark.sparkContext.broadcast(basis(fit / np.linalg.norm(fit, axis=1, keepdims=True)))
    sized = reps.select("rep", "vector", "weight", "label", F.size("vector").alias("dim"))
    schema = T.StructType([*sized.schema.fields, T.StructField("path", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    placed = materialize(sized.mapInArrow(_projected(model), schema), "projected")
    most = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    depth = F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.col("most"))))).cast("int")
    labels = placed.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("most", most).withColumn("depth", depth)
    labels = materialize(labels.select("label", "dim", "most", "depth"), "label-sizes")
    celled = placed.join(labels, ["label", "dim"]).withColumn("cell", F.expr(f"shiftright(path, {DEPTH} - depth)")).drop("path", "depth")
    celled = materialize(celled, "cells")
    cells = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.first("most")).alias("parts"))
    tiled = celled.join(materialize(cells, "cell-sizes"), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts")).drop("parts", "most")
    tiled = materialize(tiled.withColumn("tile", F.struct("cell", "part")), "tiles")
    sides = [f(F.get("x", k)).alias(f"{n}{k}") for k in range(DIRECTIONS) for n, f in (("l", F.min), ("h", F.max))]
    boxes = materialize(tiled.groupBy("label", "dim", "tile").agg(*sides), "boxes")
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = " + ".join(f"power(greatest(0D, a.l{k} - b.h{k}, b.l{k} - a.h{k}), 2)" for k in range(DIRECTIONS))
    close = F.expr(f"a.label = b.label AND a.dim = b.dim AND a.tile <= b.tile AND {gap} <= {2 - 2 * threshold + 1e-6}D")
    box = lambda t: F.struct(*(F.col(f"{t}.{n}{k}").alias(f"{n}{k}") for k in range(DIRECTIONS) for n in "lh"))
    names = [F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.tile").alias("first"), F.col("b.tile").alias("second"), box("a").alias("first_box"), box("b").alias("second_box")]
    pairs = materialize(a.join(b, close).select(*names).withColumn("pair", F.monotonically_increasing_id()), "tile-pairs")
    # 0 and 1: the sides of a pair; 2: a tile with itself. other: the box that a vector has to come near to
    ends = F.expr("""if(first = second, array(named_struct('side', 2, 'tile', first, 'other', first_box)),
        array(named_struct('side', 0, 'tile', first, 'other', second_box), named_struct('side', 1, 'tile', second, 'other', first_box)))""")
    uses = pairs.select("label", "dim", "pair", F.explode(ends).alias("u")).select("label", "dim", "pair", "u.*")
    away = " + ".join(f"power(greatest(0D, x[{k}] - other.h{k}, other.l{k} - x[{k}]), 2)" for k in range(DIRECTIONS))
    t, u = tiled.alias("t"), uses.alias("u")
    near = F.expr(f"t.label = u.label AND t.dim = u.dim AND t.tile = u.tile AND {away} <= {2 - 2 * threshold + 1e-6}D")
    work = t.join(u, near).select("pair", "side", "rep", "weight", "vector")
    found = work.repartition("pair").sortWithinPartitions("pair").mapInArrow(_tile_links(threshold, model), "rep long, links long, root long")
    found = materialize(found, "vector-links")
    roots = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    keys = [F.xxhash64("label", "vector").alias("key"), F.xxhash64(F.lit(1), "vector", "label").alias("key2")]  # 128 bits
    named = reps.select("rep", "weight", *keys).join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("key", "key2", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named-vectors")
    members = materialize(rows.select("vec_id", "usable", *keys), "members")
    out = members.join(named.withColumn("usable", F.lit(True)), ["key", "key2", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    back = lambda c: F.when(c == LAST, None).otherwise(c)
    return out.select(back(F.col("vec_id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), back(component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))
