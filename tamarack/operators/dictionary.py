"""Texts against a dictionary that is a table: which terms does each text contain?

A q-gram index in two passes. Terms and texts are compared as lower-cased UTF-8 bytes. Of a term of ``WINDOW`` bytes or more only
its windows' least grams by hash are candidates, and of the text as well (any window that both share has the same least
gram); of shorter terms all grams of 8 bytes, and terms under 8 bytes are one gram of their own length. The first pass
counts the texts that hold each gram of any term, the second meets each term at its rarest gram only; then ``contains`` decides.

Texts' grams are filtered against a bit map of the dictionary's grams before any shuffle. The map has a fixed size: a dictionary that
fills it lets more grams through, which the joins then drop. Nothing else of the dictionary or the texts is held in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, discard

GRAM, WINDOW, BITS = 8, 32, 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(data: bytes, size: int) -> np.ndarray:
    """The grams of ``size`` bytes (8 at most) at every place, as numbers that tell size and bytes apart by hash."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(a) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out << np.uint64(8)) | a[k : k + n]
    out = (out ^ np.uint64(size)) * _MIX  # for grams under 8 bytes too: what falls together is told apart by contains
    return out ^ (out >> np.uint64(29))


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """The distinct least grams of all stretches of ``width`` neighbours; of fewer, the least one."""
    if len(grams) <= width:
        return grams.min(keepdims=True) if len(grams) else grams
    span, low = 1, grams
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.unique(np.minimum(low[: len(low) - rest], low[rest:]) if rest else low)


def grams_of(data: bytes, classes: frozenset[int]) -> np.ndarray:
    """A text's grams for terms of the classes: WINDOW, GRAM or a size below it."""
    parts = []
    every = packed(data, GRAM) if classes & {WINDOW, GRAM} else None
    for c in sorted(classes):
        parts.append(least(every, WINDOW - GRAM + 1) if c == WINDOW else np.unique(every if c == GRAM else packed(data, c)))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def class_of(size: int) -> int:
    return WINDOW if size >= WINDOW else GRAM if size >= GRAM else size


def _term_grams(terms: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, grams, classes = [], [], []
            for i, term in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                c = class_of(len(term))
                own = grams_of(term, frozenset([c])).view(np.int64).tolist()
                ids += [i] * len(own)
                grams += own
                classes += [c] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.int64()), pa.array(classes, pa.int32())], names=["tid", "gram", "class"])

    return terms.select("tid", "term").mapInArrow(run, "tid long, gram long, class int")


def _bit_map(grams: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits places the grams take; each task folds its own, and one row for each byte that isn't empty comes to the driver."""
    places = grams.select((F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))).alias("place"))
    rows = places.selectExpr("shiftright(place, 3) AS byte", "shiftleft(1, CAST(place & 7 AS INT)) AS bit").groupBy("byte").agg(F.bit_or("bit").alias("value"))
    got = rows.toArrow()
    out = np.zeros(max(1 << bits >> 3, 1), dtype=np.uint8)
    out[got["byte"].to_numpy()] = got["value"].to_numpy().astype(np.uint8)
    return out


def _text_grams(texts: DataFrame, known, classes: frozenset[int], bits: int) -> DataFrame:
    """(row, gram) of the texts' distinct grams that the bit map ``known`` lets through."""

    def run(batches):
        taken, mask = known.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            rows, grams = [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = grams_of(text, classes)
                place = own & mask
                own = own[(taken[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                rows.append(np.full(len(own), r, dtype=np.int64))
                grams.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(grams))], names=["row", "gram"])

    return texts.select("row", "text").mapInArrow(run, "row long, gram long")


def match_dictionary(texts: DataFrame, terms: DataFrame, text_id: str, text: str, term_id: str, term: str, bits: int = BITS) -> DataFrame:
    """(text_id, term_id) for each text that contains the term, upper and lower case alike; ids may repeat, pairs are distinct.

    Null texts contain nothing; null and empty terms are in no text. Texts meet each distinct term once; the ids that share it come last.
    """
    spark = texts.sparkSession
    given = cut(terms.select(F.lower(F.col(term).cast("string")).alias("term"), F.col(term_id).alias("_id")).where("term != ''").distinct(), "terms")
    wanted = cut(given.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "distinct-terms")
    where = cut(texts.select(F.lower(F.col(text).cast("string")).alias("text"), F.col(text_id).alias("_text_id")).where("text != ''").withColumn("row", F.monotonically_increasing_id()), "texts")
    grams = cut(_term_grams(wanted), "term-grams")
    classes = frozenset(r["class"] for r in grams.select("class").distinct().collect())  # nine at most
    known = spark.sparkContext.broadcast(_bit_map(grams, bits))
    met = cut(_text_grams(where, known, classes, bits), "text-grams")
    counts = met.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("tid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("one")).where("one.n > 0")
    rarest = cut(rarest.select("tid", "one.gram"), "rarest-grams")
    pairs = cut(met.join(rarest, "gram").select("row", "tid"), "candidates")
    near = where.join(pairs.join(wanted, "tid").select("row", "term"), "row").where(F.contains("text", "term"))
    found = cut(near.select("_text_id", "term").distinct(), "found-terms")
    hits = found.join(given, "term").select(F.col("_text_id").alias(text_id), F.col("_id").alias(term_id))
    several = not given.groupBy("_id").count().where("count > 1").isEmpty()  # only an id of several terms can meet a text twice
    out = cut(hits.distinct() if several else hits, "dictionary-hits")
    discard(given, wanted, where, grams, met, rarest, pairs, found)
    return out
