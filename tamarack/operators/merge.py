"""Merging lead tables: dedupe, upsert, patches with evidence, hand-off results.

Input order matters ("the first filled value wins"), so every input carries an ordinal column ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bool_string, clean_text, filled, first_filled, has, lead_id, merge_tokens, normalize_domain, parse_confidence, parse_score, split_tokens, valid_email
from .budget import order_ranges

# Columns of lead rows that hold scores or token lists.
SCORES = ["vhd_fit_score", "lead_score", "input_lead_score"]
TOKENS = ["signals", "input_signals", "possible_shop_levers", "verified_signals"]
# Columns that an upsert fills only where the stored row has none.
FILL = ["url", "website_url", "shop_name", "company_name", "country", "language", "verification_status", "verification_score", "domain_alive", "is_shop", "is_woocommerce", "woocommerce_confidence", "shop_relevance_score", "technical_pain_score", "conversion_pain_score", "business_potential_score", "lead_grade", "lead_grade_reason", "priority"]


def _present(name: str, columns: list[str]) -> Column:
    return F.col(name) if name in columns else F.lit(None).cast("string")


def first_per_key(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key, by order; keyed by aggregation, so that a hot key isn't sorted in one task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def last_per_key(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key: later rows replace earlier ones."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def joined_tokens(rows: DataFrame, key: str, columns: list[str], order: str = "ord") -> DataFrame:
    """For each key the distinct tokens of each column, lower-cased, by their first place.

    First places are taken before tokens are gathered, so a key's rows meet in no task, only its distinct tokens.
    """

    def placed(k: int, c: str) -> Column:
        return F.transform(split_tokens(c, lower=True), lambda t, i: F.struct(F.lit(k).alias("which"), i.alias("pos"), t.alias("token")))

    each = [placed(k, c) for k, c in enumerate(columns)]
    firsts = rows.select(key, order, F.explode(F.concat(*each)).alias("t")).groupBy(key, "t.which", "t.token").agg(F.min(F.struct(order, "t.pos")).alias("place"))
    one = F.struct("place", "token")
    lists = [F.array_sort(F.collect_list(F.when(F.col("which") == k, one))).alias(c) for k, c in enumerate(columns)]
    return firsts.groupBy(key).agg(*lists).select(key, *(F.array_join(F.transform(c, lambda x: x["token"]), "|").alias(c) for c in columns))


def joined_notes(rows: DataFrame, key: str, column: str = "notes", order: str = "ord", per_range: int = 200_000) -> DataFrame:
    """For each key its filled notes in order, joined range by range: a task holds the rows of one range, then one text of each."""
    filled_in = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).select(key, order, column)
    place, _ = order_ranges(filled_in, order, per_range)
    in_order = lambda parts, value: F.array_join(F.transform(F.array_sort(parts), lambda x: x[value]), " | ")
    pieces = filled_in.withColumn("_range", place).groupBy(key, "_range").agg(in_order(F.collect_list(F.struct(order, column)), column).alias(column))
    return pieces.groupBy(key).agg(in_order(F.collect_list(F.struct("_range", column)), column).alias(column))


def dedupe_leads(rows: DataFrame) -> DataFrame:
    """One row per domain, as folding the rows in order gives it.

    The better score wins, ties stay with the earlier row, and blanks are filled from the loser. That equals
    a precedence: the rows that raise the running maximum, latest first, then the others in
    order. Token lists are united and notes joined in input order. Takes ``ord``, a distinct number; rows without a domain are dropped.

    A row that raises the maximum is the first one of its score, so rows are combined by (domain, score) first, before any
    shuffle: the first row as a whole, and for each column its first filled value. Only a domain's distinct scores meet in one
    task; of them those raise it whose first row comes before the first rows of all higher scores.
    """
    columns = rows.columns
    domain = F.coalesce(*(filled(_present(c, columns)) for c in ("domain", "source_url", "url")))
    score = F.greatest(*(parse_score(_present(c, columns)) for c in SCORES))
    keyed = rows.withColumns({"_key": normalize_domain(domain), "_score": score}).where(F.col("_key") != "")
    tokens = [c for c in TOKENS if c in columns]
    plain = [c for c in columns if c not in ("domain", "ord", "notes", *TOKENS)]
    firsts = [a for i, c in enumerate(plain) for a in (F.min_by(c, F.when(has(c), F.col("ord"))).alias(f"_v{i}"), F.min(F.when(has(c), F.col("ord"))).alias(f"_o{i}"))]
    by_score = keyed.groupBy("_key", "_score").agg(F.min("ord").alias("ord"), F.min_by(F.struct(F.lit(0).alias("_"), *plain), "ord").alias("_row"), *firsts)
    higher = F.expr("min(ord) OVER (PARTITION BY _key ORDER BY _score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    by_score = by_score.withColumn("_higher", higher).withColumn("_raises", F.col("_higher").isNull() | (F.col("ord") < F.col("_higher")))

    def pick(i: int, c: str) -> Column:
        own = F.col("_row")[c]
        return F.coalesce(F.max_by(own, F.when(F.col("_raises") & has(own), F.col("ord"))), F.min_by(f"_v{i}", f"_o{i}")).alias(c)

    out = by_score.groupBy("_key").agg(F.min("ord").alias("ord"), *(pick(i, c) for i, c in enumerate(plain)))
    if tokens:
        out = out.join(joined_tokens(keyed, "_key", tokens), "_key", "left").na.fill("", tokens)
    if "notes" in columns:
        out = out.join(joined_notes(keyed, "_key"), "_key", "left").na.fill("", ["notes"])
    return out.withColumnRenamed("_key", "domain").select("domain", *[c for c in columns if c != "domain"])


def incoming_by_domain(rows: DataFrame, key: str = "domain_key", keyless: bool = False) -> DataFrame:
    """Incoming rows folded per key: the first filled value of each column, in order, and the number of rows.

    Rows without a key are left out, or folded under the empty key if ``keyless``.
    """
    values = [c for c in rows.columns if c not in (key, "ord")]
    rows = rows.withColumn(key, F.when(has(key), F.col(key)).otherwise("")) if keyless else rows.where(has(key))
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(has(c), F.col("ord"))).alias(c) for c in values), F.count("*").alias("n_rows"), F.min("ord").alias("ord"))


def upsert_leads(master: DataFrame, incoming: DataFrame, source: str, run_id: str, now: str, keyless: bool = False) -> DataFrame:
    """Full outer merge on ``domain_key``: stored values win, blanks are filled, provenance lists grow.

    New keys get a surrogate key, defaults and the fields of a canonical row. ``is_created`` and ``is_updated`` say what
    happened to each row, ``incoming_rows`` how many rows came for it. ``keyless`` adds a row of the empty key for the
    incoming rows without one, for counting; it isn't to be stored.
    """
    new = incoming_by_domain(incoming, keyless=keyless)
    new = new.select(F.col("domain_key").alias("_key"), "n_rows", *(F.col(c).alias(f"_{c}") for c in new.columns if c in FILL))
    joined = master.withColumn("_stored", F.lit(True)).join(new, master["domain_key"] == new["_key"], "full_outer")
    created, met = F.col("_stored").isNull(), F.col("n_rows").isNotNull()
    key = F.coalesce("domain_key", "_key")
    out = {}
    for c in dict.fromkeys([*master.columns, *FILL]):
        old = _present(c, master.columns)
        out[c] = first_filled(old, f"_{c}") if f"_{c}" in new.columns else clean_text(old)
    fresh = lambda c, value: F.when(created, value).otherwise(out.get(c, F.lit("")))
    for c, value in (("source_lists", source), ("scrape_sources_all", source), ("scrape_run_ids", run_id)):
        old = _present(c, master.columns)
        out[c] = F.when(met, merge_tokens(old, F.lit(value))).otherwise(clean_text(old))
    out["website_url"] = F.when(created & (out["website_url"] == ""), F.concat(F.lit("https://"), key, F.lit("/"))).otherwise(out["website_url"])
    for c in ("last_seen_at", "updated_at"):
        out[c] = F.when(met, now).otherwise(clean_text(_present(c, master.columns)))
    out["last_run_id"] = F.when(met, run_id).otherwise(clean_text(_present("last_run_id", master.columns)))
    ident = lead_id(key)
    for c, value in (("first_seen_at", F.lit(now)), ("created_at", F.lit(now)), ("lead_id", ident), ("domain", key), ("scrape_source_primary", F.lit(source))):
        out[c] = fresh(c, value)
    for c, value in (("canonical_lead_id", ident), ("duplicate_group_id", key), ("duplicate_status", F.lit("canonical"))):
        old = out.get(c, F.lit(""))
        out[c] = F.when(met & (old == ""), value).otherwise(old)
    out["domain_key"] = key
    out |= {"is_created": created, "is_updated": ~created & met | (created & (F.col("n_rows") > 1)), "incoming_rows": F.coalesce("n_rows", F.lit(0))}
    return joined.select(*(c.alias(n) for n, c in out.items()))


def upsert_counts(incoming: DataFrame, merged: DataFrame) -> DataFrame:
    """records_read, records_created, records_updated (rows that met a stored key) and records_skipped (no key)."""
    read = incoming.agg(F.count("*").alias("records_read"), F.count_if(~has("domain_key")).alias("records_skipped"))
    done = merged.agg(F.count_if("is_created").alias("records_created"), F.coalesce(F.sum(F.when(F.col("is_created"), F.col("incoming_rows") - 1).otherwise(F.col("incoming_rows"))), F.lit(0)).alias("records_updated"))
    return read.join(done)


def reduce_patches(patches: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Several patches of a key: each column's last filled value, in order."""
    return patches.where(has(key)).groupBy(key).agg(*(F.max_by(c, F.when(has(c), F.col("ord"))).alias(c) for c in values))


def evidence_winner(rows: DataFrame, key: list[str], value: str = "value", confidence: str = "confidence", carried: tuple[str, ...] = ()) -> DataFrame:
    """The value of highest confidence for each key; ties go to the later row, blanks never win, scored beats unscored.

    A stored row takes part as the row of ``ord`` -1. What is ``carried`` travels with the winner.
    """
    best = F.max_by(F.struct(value, confidence, *carried), F.struct(parse_confidence(confidence), F.col("ord")))
    return rows.where(has(value)).groupBy(*key).agg(best.alias("w")).select(*key, "w.*")


def apply_patches(leads: DataFrame, patches: DataFrame, key: str, values: list[str], evidence: list[str] = ()) -> DataFrame:
    """Leads with patches applied: filled cells overwrite, blanks never clear, evidence goes by confidence (see ``evidence_winner``).

    One aggregation of the patches and one join, whatever the number of columns: each field's best patch then meets what is stored.
    """
    parts = {f: [f, f"{f}_source", f"{f}_confidence", f"{f}_checked_at"] for f in evidence}
    latest = [F.max_by(c, F.when(has(c), F.col("ord"))).alias(f"_{c}") for c in values]
    best = [F.max_by(F.struct(*(_present(p, patches.columns).alias(p) for p in ps)), F.when(has(f), F.struct(parse_confidence(_present(ps[2], patches.columns)), F.col("ord")))).alias(f"_best_{f}") for f, ps in parts.items()]
    reduced = patches.where(has(key)).groupBy(key).agg(F.lit(True).alias("_patched"), *latest, *best)
    out = leads.join(reduced, key, "left")
    cells = {c: F.coalesce(filled(f"_{c}"), clean_text(_present(c, leads.columns))) for c in values}
    cells["is_patched"] = F.coalesce("_patched", F.lit(False))
    for f, ps in parts.items():
        stored, fresh = {p: _present(p, leads.columns) for p in ps}, F.col(f"_best_{f}")
        known, offered = parse_confidence(stored[ps[2]]), parse_confidence(fresh[ps[2]])
        # ties go to the patch, as the later row; scored beats unscored
        takes = fresh.isNotNull() & (~has(stored[f]) | known.isNull() | F.coalesce(offered >= known, F.lit(False)))
        cells |= {p: clean_text(F.when(takes, fresh[p]).when(has(stored[f]), stored[p])) for p in ps}
    return out.withColumns(cells).drop("_patched", *(f"_{c}" for c in values), *(f"_best_{f}" for f in parts))


def unmatched_patches(leads: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    return patches.join(leads.select(key), key, "left_anti")


# Where a hand-off result may hold its address and its status.
RESULT_EMAILS = ["personal_email", "email_personal", "email"]
RESULT_STATUSES = ["email_verification_status", "verification_status", "status"]


def join_handoff_results(leads: DataFrame, results: DataFrame) -> DataFrame:
    """Leads with their hand-off result, matched by lead_id, else by domain; the last row of a key wins.

    Sets the address if it is valid, the status and the flags. Two equi-joins, never one join with OR.
    """
    have = results.columns
    pick = lambda names: F.coalesce(*(filled(_present(n, have)) for n in names), F.lit(""))
    flat = results.select(clean_text(_present("lead_id", have)).alias("lead_id"), normalize_domain(_present("domain", have)).alias("domain"), F.lower(pick(RESULT_EMAILS)).alias("email"), F.lower(pick(RESULT_STATUSES)).alias("status"), clean_text(_present("email_source", have)).alias("source"), "ord")
    hit = F.max_by(F.struct("email", "status", "source"), "ord")
    by_id = flat.where(F.col("lead_id") != "").groupBy("lead_id").agg(hit.alias("_by_id"))
    by_domain = flat.where(F.col("domain") != "").groupBy(F.col("domain").alias("_domain")).agg(hit.alias("_by_domain"))
    joined = leads.join(by_id, "lead_id", "left").join(by_domain, normalize_domain(leads["domain"]) == F.col("_domain"), "left")
    got = F.coalesce("_by_id", "_by_domain")
    met = got.isNotNull()
    keep = lambda c: clean_text(_present(c, leads.columns))
    out = {
        "personal_email": F.when(met & (got["email"] != "") & valid_email(got["email"]), got["email"]).otherwise(keep("personal_email")),
        "email_verification_status": F.when(met & (got["status"] != ""), got["status"]).otherwise(keep("email_verification_status")),
        "email_source": F.when(met, F.coalesce(F.nullif(got["source"], F.lit("")), F.lit("clay_manual_import"))).otherwise(keep("email_source")),
        "clay_used": F.when(met, "true").otherwise(keep("clay_used")),
        "clay_eligible": F.when(met, "false").otherwise(keep("clay_eligible")),
        "clay_reason": F.when(met, "Clay result imported; manual compliance approval still required.").otherwise(keep("clay_reason")),
    }
    return joined.withColumns(out).withColumn("result_matched", bool_string(met)).drop("_by_id", "_by_domain", "_domain")
