"""Personal data: patterns for e-mail, IP, card and phone, and information-theoretic sanitisation of terms.

Everything here is DataFrame operations. Patterns find the protected entities. Over all documents, the
co-occurrence of entity e and term t in whole documents estimates how much of e's information t discloses:
``log(p(e|t) / p(e)) / -log p(e)``, with p as shares of documents and p(e|t) smoothed by a prior that weighs ``PRIOR``
documents, so that entities met once or twice are rated too and one meeting weighs less than many. Where a term discloses
``threshold`` of an entity or more, each of its occurrences in documents that hold the entity is a span of kind
``term``: removed if it discloses ``full`` or more, else generalised to a placeholder. Terms are words of three characters and
more with a letter. An entity of one document needs 243 documents in all before a term of that document alone is rated.
Entities that stand in the same documents are rated as one group: a text with very many addresses of its own has one group.

Offsets are code points, ends exclusive. Null text counts as empty. Repeated rows count as documents of their own, in
every count alike, and get the same spans. Time is linear in a text's length and in its number of matches, but for the
sorting of its spans. Term spans that overlap a pattern's span are left out. A null doc_id is a value like any
other. Other columns are not read, and in ``sanitise`` stay as they are, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: A match may start after a sign that can't be in it, or where the match before ended: all other starts
#: fail as the first one of the run does. Possessive groups keep long runs from recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]++"
MARK, OTHER = "\x01", "\x02"
LAST = (1 << 63) - 1
#: Documents that the prior weighs: p(e|t) is drawn to p(e) as if t stood in so many more documents without knowledge of e.
PRIOR = 2
#: Parts or cuts of a text that are taken together; even, so that a block of parts never begins with a match.
BLOCK = 256
_KEY = ["doc_id", "text_hash"]
_GROUP = ["first", "rows", "df_e"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that don't overlap.

    Marks are set around the matches and the text is split at them, so every other part is a match. Places are summed up block by
    block, so that no long array is copied for each match.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.char_length(part)
        match = F.struct(a["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["found"], F.array(match))).otherwise(a["found"]).alias("found"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.char_length(x)))
        firsts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        one = lambda b, first: F.aggregate(b, F.struct(first.alias("at"), F.lit(False).alias("inside"), none.alias("found")), step, lambda a: a["found"])
        return _let(firsts, lambda firsts: F.flatten(F.transform(blocks, lambda b, i: one(b, F.get(firsts, i)))))

    def blocks_of(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, k * BLOCK + 1, BLOCK))

    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return _let(parts, lambda parts: _let(blocks_of(parts), placed))


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _ranked(found: Column, kind: str, rank: int) -> Column:
    kept = F.filter(found, lambda m: _valid(kind, m["value"]))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")))


#: Texts without these can't match: spares most texts the marking.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}


def entities(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, found) per row; found is an array of (start, rank, end, value) by start, then kind; text is null where found is empty."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    per_kind = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        ranked = _ranked(_found(F.col("text"), pattern), kind, rank)
        per_kind.append(F.when(F.col("text").rlike(_HINT[kind]), ranked).otherwise(none))
    every = F.array_sort(F.concat(*per_kind))
    held = F.when(F.size("found") > 0, F.col("text")).alias("text")
    return rows.withColumn("found", every).select(*_KEY, "found", held)


def _entity(m: Column) -> Column:
    """An entity's name: the kind's rank, and the value (its digits for cards and phones)."""
    return F.concat_ws(":", m["rank"], F.when(m["rank"].isin(2, 3), _digits(m["value"])).otherwise(F.lower(m["value"])))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}\p{N}]++"), lambda w: F.lower(w)))


def document_frequency(documents: DataFrame) -> DataFrame:
    """(term, df): number of rows of ``documents`` that hold each term, counted once per row, so that little is shuffled."""
    words = documents.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).where((F.char_length("term") >= 3) & F.col("term").rlike(r"\p{L}"))


def _share(both: Column, df: Column, df_e: Column, n: Column) -> Column:
    return F.log((both * n / df_e + PRIOR) / (df + PRIOR)) / F.log(n / df_e)


def disclosing(held: DataFrame, documents: DataFrame, threshold: float, common: int = 2000) -> DataFrame:
    """(id, start, end, share): the places of the terms of each row of ``held`` that disclose at least ``threshold`` of an entity in it.

    ``held`` has id, n, text and names (the row's distinct entities). A term and an entity are paired only where they may meet in
    two texts; those that meet in one are rated without pairs, so a text with very many entities costs its terms once, not once
    for each. Pairs that no count could bring to the threshold are left out before they are counted; so are the ``common`` most frequent of the terms too frequent for any entity, before any shuffle.
    """
    df_t = materialize(document_frequency(documents), "term-counts")
    names = held.select("id", "n", F.explode("names").alias("entity"))
    rows = names.groupBy("entity").agg(F.count("*").alias("df_e"), F.min("id").alias("first"), F.expr("bit_xor(xxhash64(id))").alias("rows"))
    rows = materialize(rows, "entity-rows")
    most = (F.col("df_e") + PRIOR * F.col("df_e") / F.col("n")) * F.pow(F.col("n") / F.col("df_e"), F.lit(1 - threshold)) * 1.000001 - PRIOR
    groups = names.join(rows, "entity").where("df_e < n").select("id", "n", *_GROUP, most.alias("most")).distinct()
    groups = materialize(groups, "entity-groups")
    limit = groups.agg(F.max("most")).first()[0]
    if limit is None:
        return held.select("id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("share")).limit(0)
    frequent = [r.term for r in df_t.where(F.col("df") > limit).orderBy(F.desc("df"), "term").limit(common).collect()]
    words = held.select("id", F.explode(_found(F.col("text"), WORD)).alias("w")).select("id", F.lower("w.value").alias("term"), "w.start", "w.end")
    words = words.where((F.char_length("term") >= 3) & F.col("term").rlike(r"\p{L}"))
    words = materialize(words.where(~F.col("term").isin(frequent)) if frequent else words, "held-words")
    rare = words.select("id", "term").distinct().join(df_t.where(F.col("df") <= limit), "term")
    rare = materialize(rare.select("id", "term", "df"), "rare-terms")
    # meeting once, a term discloses most of the text's rarest entity: the share falls as df_e grows
    lowest = groups.groupBy("id", "n").agg(F.min("df_e").alias("df_e"))
    once = rare.join(lowest, "id").select("id", "term", _share(F.lit(1), F.col("df"), F.col("df_e"), F.col("n")).alias("share"))
    # what meets twice or more meets in another text than the one of the group that has most terms; that one is looked up
    texts = groups.where("df_e > 1").join(rare.groupBy("id").agg(F.count("*").alias("size")), "id")
    largest = texts.groupBy(*_GROUP).agg(F.max(F.struct("size", "id")).alias("top")).select(*_GROUP, F.col("top.id").alias("largest"))
    texts = materialize(texts.join(largest, _GROUP).where("id != largest").select("id", "n", *_GROUP, "most", "largest"), "entity-texts")
    pairs = rare.where("df > 1").join(texts, "id").where("df <= most").select("id", "largest", "n", *_GROUP, "term", "df")
    pairs = materialize(pairs, "entity-terms")
    counted = pairs.groupBy(*_GROUP, "term", "largest").agg(F.count("*").alias("both"), F.first("df").alias("df"), F.first("n").alias("n"))
    there = rare.select(F.col("id").alias("largest"), "term", F.lit(True).alias("there"))
    counted = counted.join(there, ["largest", "term"], "left").withColumn("both", F.col("both") + F.col("there").isNotNull().cast("long"))
    rated = counted.withColumn("share", _share(F.col("both"), F.col("df"), F.col("df_e"), F.col("n"))).where((F.col("both") > 1) & (F.col("share") >= threshold))
    rated = materialize(rated.select(*_GROUP, "term", "share", "largest", "there"), "disclosing")
    more = pairs.join(rated, [*_GROUP, "term"]).select("id", "term", "share").unionByName(rated.where("there").select(F.col("largest").alias("id"), "term", "share"))
    best = once.where(F.col("share") >= threshold).unionByName(more).groupBy("id", "term").agg(F.max("share").alias("share"))
    best = materialize(best, "disclosing-terms")
    out = materialize(words.join(best, ["id", "term"]).select("id", "start", "end", "share"), "term-places")
    discard(df_t, rows, groups, words, rare, texts, pairs, rated, best)
    return out


def _free(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, terms): the places that overlap no pattern's span of their row."""
    base = found.select("id", F.explode("found").alias("b")).select("id", "b.start", "b.end", F.lit(None).cast("double").alias("share"))
    by = Window.partitionBy("id")  # both frames grow from their first row, so each row is added once
    is_base = F.col("share").isNull()
    before = F.max(F.when(is_base, F.col("end"))).over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    both = placed.unionByName(base).withColumns({"before": before, "after": after})
    clear = both.where("share IS NOT NULL AND coalesce(before, 0) <= start AND (after IS NULL OR after >= end)")
    term = F.struct("start", F.lit(4).alias("rank"), "end", "share")
    return clear.groupBy("id").agg(F.collect_list(term).alias("terms"))


def spans(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, doc_id, text_hash, found, terms) per row: pattern spans, and term spans as (start, rank, end, share).

    A null doc_id stands as the largest long.
    """
    found = materialize(entities(documents).withColumn("id", F.monotonically_increasing_id()), "entities")
    n = F.lit(float(max(found.count(), 1)))
    held = found.where("text IS NOT NULL").select("id", n.alias("n"), "text", F.array_distinct(F.transform("found", _entity)).alias("names"))
    placed = disclosing(held, documents, threshold)
    terms = materialize(_free(placed, found), "terms")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,share:double>>")
    out = found.join(terms, "id", "left").select("id", *_KEY, "found", F.coalesce("terms", none).alias("terms"))
    out = materialize(out, "spans")
    discard(found, terms)
    return out


def _named(every: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _count(found: Column, rank: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long")


def _plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def report(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    rows = spans(documents)
    counts = [_count(F.col("found"), rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    every = F.array_sort(F.concat(_plain(F.col("found")), _plain(F.col("terms"))))
    doc_id = F.expr(f"nullif(doc_id, {LAST}L)").alias("doc_id")
    return rows.select(doc_id, *counts, F.sha2(_named(_plain(F.col("found"))), 256).alias("base_sha256"), _named(every).alias("spans"))


def _cuts(rows: DataFrame, full: float) -> DataFrame:
    """(id, cuts): the spans of each row, those that overlap as one, as sorted (start, end, label)."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(labels, s["rank"]).alias("label")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.when(s["share"] >= full, "").otherwise("[TERM]").alias("label")))
    every = rows.select("id", F.explode(F.concat(base, terms)).alias("s")).select("id", "s.*")
    order = Window.partitionBy("id").orderBy("start", "rank")
    opens = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = every.withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.struct("start", "rank")).alias("label"))
    return merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("cuts"))


def _cleaned(text: Column, cuts: Column) -> Column:
    """The text with its cuts replaced by their labels; stretches of ``BLOCK`` cuts are taken out of the text first."""

    def stretch(k: Column) -> Column:
        own = F.slice(cuts, k * BLOCK + 1, BLOCK)
        first = F.when(k == 0, 0).otherwise(F.get(cuts, k * BLOCK)["start"])
        last = F.coalesce(F.get(cuts, (k + 1) * BLOCK)["start"], F.char_length(text))
        return F.struct(first.alias("first"), F.substring(text, first + 1, last - first).alias("text"), own.alias("own"))

    def step(part: Column) -> Callable:
        def add(a: Column, s: Column) -> Column:
            more = F.concat(a["out"], F.substring(part["text"], a["at"] - part["first"] + 1, s["start"] - a["at"]), s["label"])
            return F.struct(s["end"].alias("at"), more.alias("out"))

        return add

    def joined(part: Column) -> Column:
        start = F.struct(part["first"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(part["own"], start, step(part), lambda a: F.concat(a["out"], F.substring(part["text"], a["at"] - part["first"] + 1, F.char_length(part["text"]))))

    numbers = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / BLOCK).cast("int"))
    return F.concat_ws("", F.transform(F.transform(numbers, stretch), joined))


def sanitise(documents: DataFrame, full: float = 0.95) -> DataFrame:
    """``documents`` with pattern spans and generalised terms replaced by placeholders, and fully disclosing terms removed.

    Spans that overlap are replaced as one by the first one's placeholder. n_chars, where there is one, is counted anew.
    """
    i, h, c = unused(documents.columns, "id", "hash", "cuts")
    found = spans(documents)
    rows = found.where((F.size("found") > 0) | (F.size("terms") > 0)).dropDuplicates(_KEY)
    cuts = rows.select("id", *_KEY).join(_cuts(rows, full), "id")
    cuts = materialize(cuts.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("cuts").alias(c)), "cuts")
    discard(found)
    marked = documents.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64("text")})
    clean = _cleaned(F.col("text"), F.col(c))
    out = marked.join(cuts, [i, h], "left").withColumn("text", F.when(F.col(c).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
