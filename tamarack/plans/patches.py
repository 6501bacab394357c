"""Patches for the master from verification, enrichment and hand-off tables, and their import.

A patch is a table with the master's columns, blank where the source says nothing; ``now`` is the run's one timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bool_string, clean_text, first_filled, normalize_domain, normalize_url, parse_score, resolve_aliases, truthy
from ..operators.classify import grade
from ..operators.merge import apply_patches, upsert_counts, upsert_leads

# Under which headers each source may carry a column, in order of preference.
SCRAPE_ALIASES = {
    "domain": ["domain", "domain_key", "website_domain", "shop_domain", "source_domain"],
    "url": ["url", "source_url", "page_url", "shop_url", "website", "website_url"],
    "website_url": ["website_url", "website", "homepage", "site_url", "shop_url", "url"],
    "shop_name": ["shop_name", "store_name", "shop", "title", "name"],
    "company_name": ["company_name", "company", "business_name", "legal_name", "name"],
    "country": ["country", "country_hint", "country_code"],
    "language": ["language", "lang", "locale"],
    "verification_status": ["verification_status"],
    "verification_score": ["verification_score", "domain_score"],
    "domain_alive": ["domain_alive", "alive"],
    "is_shop": ["is_shop", "shop_detected"],
    "is_woocommerce": ["is_woocommerce", "woocommerce_detected"],
    "woocommerce_confidence": ["woocommerce_confidence"],
    "shop_relevance_score": ["shop_relevance_score"],
    "technical_pain_score": ["technical_pain_score"],
    "conversion_pain_score": ["conversion_pain_score"],
    "business_potential_score": ["business_potential_score", "vhd_fit_score", "lead_score"],
    "lead_grade": ["lead_grade", "overall_priority", "lead_quality"],
    "lead_grade_reason": ["lead_grade_reason", "priority_reason"],
    "priority": ["priority", "overall_numeric_score"],
}
VERIFICATION_ALIASES = {
    "lead_id": ["lead_id"],
    "domain_key": ["domain_key", "domain", "website_url", "url"],
    "website_url": ["website_url", "source_url", "url"],
    "verification_status": ["verification_status", "status"],
    "verification_score": ["verification_score", "vhd_fit_score", "score"],
    "domain_alive": ["domain_alive", "alive"],
    "is_shop": ["is_shop", "shop_detected"],
    "is_woocommerce": ["is_woocommerce", "woocommerce_detected"],
    "woocommerce_confidence": ["woocommerce_confidence"],
    "detected_platform": ["detected_platform"],
    "niche": ["niche"],
    "care_lead_type": ["care_lead_type"],
    "ik_number": ["ik_number"],
    "scale_indicators": ["scale_indicators"],
    "verification_evidence_url": ["verification_evidence_url", "evidence_url", "source_url", "url"],
    "verification_checked_at": ["verification_checked_at", "checked_at", "last_scored_at"],
    "verification_error": ["verification_error", "error", "error_reason", "policy_skip_reason"],
    "business_potential_score": ["business_potential_score", "vhd_fit_score", "score"],
    "lead_grade": ["lead_grade", "lead_quality", "overall_priority", "category"],
    "lead_grade_reason": ["lead_grade_reason", "possible_shop_levers", "notes", "error_reason"],
    "next_action": ["next_action"],
    "next_action_reason": ["next_action_reason", "waterfall_reason", "notes"],
    "review_reason": ["review_reason", "exclusion_reason", "policy_skip_reason", "error_reason"],
}
ENRICHMENT_ALIASES = {
    "lead_id": ["lead_id"],
    "domain_key": ["domain_key", "domain", "website_url", "source_url", "url"],
    "company_name": ["company_name"],
    "legal_name": ["legal_name"],
    "imprint_url": ["imprint_url"],
    "email_general": ["email_general", "general_email", "email"],
    "phone_main": ["phone_main", "phone"],
    "decision_maker_1_name": ["decision_maker_1_name", "managing_director_name", "managing_director", "owner_name"],
    "decision_maker_1_role": ["decision_maker_1_role"],
    "linkedin_company_url": ["linkedin_company_url"],
    "linkedin_person_url": ["linkedin_person_url"],
    "lead_grade": ["lead_grade", "overall_priority", "lead_quality"],
    "lead_grade_reason": ["lead_grade_reason", "why_relevant", "pain_summary", "possible_shop_levers"],
    "outreach_angle": ["outreach_angle", "pain_summary", "why_relevant"],
    "next_action": ["next_action", "next_enrichment_step"],
    "do_not_contact": ["do_not_contact"],
    "do_not_contact_reason": ["do_not_contact_reason"],
    "clay_needed": ["clay_needed", "clay_eligible"],
    "clay_status": ["clay_status"],
}
HANDOFF_ALIASES = {
    "lead_id": ["lead_id"],
    "domain_key": ["domain_key", "domain", "website_url", "url"],
    "legal_name": ["legal_name", "company_legal_name"],
    "imprint_url": ["imprint_url"],
    "email_general": ["email_general", "email_business", "business_email", "email"],
    "phone_main": ["phone_main", "phone_business", "business_phone", "phone"],
    "decision_maker_1_name": ["decision_maker_1_name", "decision_maker_name", "person_name"],
    "decision_maker_1_role": ["decision_maker_1_role", "decision_maker_role", "person_role"],
    "linkedin_company_url": ["linkedin_company_url", "company_linkedin_url"],
    "linkedin_person_url": ["linkedin_person_url", "person_linkedin_url"],
    "clay_status": ["clay_status", "status"],
    "clay_notes": ["clay_notes", "notes"],
}
# Columns that carry evidence, and reasons of skipped rows.
EVIDENCE = ["legal_name", "imprint_url", "email_general", "phone_main", "decision_maker_1_name", "linkedin_company_url", "linkedin_person_url"]
SKIPS = ["domain_cooldown", "robots_blocked", "domain_blocked"]


def _cell(rows: DataFrame, *names: str) -> Column:
    found = [n for n in names if n in rows.columns]
    return first_filled(*found) if found else F.lit("")


def _resolved(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Source columns as they are, and each target as ``_t_<name>``."""
    targets = resolve_aliases(rows.columns, {f"_t_{k}": v for k, v in aliases.items()})
    return rows.select("*", *targets)


def scrape_rows(rows: DataFrame) -> DataFrame:
    """Imported list rows with the master's names, domain_key and https addresses; ``ord`` is kept."""
    r = rows.select("ord", *resolve_aliases(rows.columns, SCRAPE_ALIASES))
    key = normalize_domain(first_filled("domain", "website_url", "url"))
    r = r.withColumn("domain_key", key)
    return r.withColumns({"domain": F.col("domain_key"), "website_url": normalize_url(first_filled("website_url", "url"), "domain_key"), "url": normalize_url("url", "domain_key")})


def verification_patch(rows: DataFrame, now: str) -> DataFrame:
    """Patches from verification rows: skipped sites touch only the notice and its time, others status, grade, confidence and review.

    A care provider of grade A or better loses its contact block; the block's reason stays, since blanks never clear.
    """
    r = _resolved(rows, VERIFICATION_ALIASES)
    t = lambda n: F.col(f"_t_{n}")
    skipped = (F.lower(_cell(r, "lead_type")) == "skipped") & F.lower(_cell(r, "policy_skip_reason")).isin(SKIPS)
    source = {c: clean_text(c) for c in rows.columns if c != "ord"}
    graded = F.when(t("lead_grade") != "", t("lead_grade")).otherwise(grade(source))
    failed = _cell(r, "error_reason", "verification_error", "error") != ""
    status = F.when(failed, "failed").when(truthy(_cell(r, "skipped_by_robots")), "blocked").when(_cell(r, "lead_type", "checked_at", "vhd_fit_score", "best_status", "score") != "", "done").otherwise("")
    best = _cell(r, "best_status", "http_status")
    alive = F.when(best != "", best.rlike("^[23]")).otherwise(parse_score(_cell(r, "reachable_pages")) > 0)
    r = r.withColumns({"_grade": graded, "_skip": skipped})
    kind = F.lower(_cell(r, "care_lead_type"))
    review = (F.col("_grade") == "Review") | (_cell(r, "lead_type") == "review")
    out = {n: t(n) for n in VERIFICATION_ALIASES} | {
        "lead_grade": F.col("_grade"),
        "verification_status": F.when(t("verification_status") != "", t("verification_status")).when(status != "", status).otherwise("done"),
        "domain_alive": F.when(t("domain_alive") != "", t("domain_alive")).otherwise(bool_string(alive)),
        "woocommerce_confidence": F.when((t("woocommerce_confidence") == "") & (t("is_woocommerce") != ""), F.when(truthy(t("is_woocommerce")), "0.85").otherwise("0.10")).otherwise(t("woocommerce_confidence")),
        "manual_review_required": F.when(review, "true").otherwise(""),
        "review_status": F.when(F.col("_grade") == "Reject", "rejected").when(review, "manual_review").otherwise(""),
        "do_not_contact": F.when(F.col("_grade").isin("A++", "A+", "A") & (kind == "pflegebox_anbieter"), "false").otherwise(""),
        "verification_checked_at": F.when(t("verification_checked_at") != "", t("verification_checked_at")).otherwise(now),
    }
    notice = {"verification_error": F.lower(_cell(r, "policy_skip_reason")), "verification_checked_at": F.lit(now)}
    cells = {n: F.when(F.col("_skip"), notice.get(n, F.lit(""))).otherwise(c) for n, c in out.items()}
    cells["domain_key"] = normalize_domain(t("domain_key"))
    return r.select("ord", *(c.alias(n) for n, c in cells.items())).where(F.col("domain_key") != "")


def _with_evidence(cells: dict[str, Column], source: Column, confidence: Column, at: Column) -> dict[str, Column]:
    for f in EVIDENCE:
        met = cells[f] != ""
        for part, value in (("source", source), ("confidence", confidence), ("checked_at", at)):
            cells[f"{f}_{part}"] = F.when(met, value).otherwise("")
    return cells


def enrichment_patch(rows: DataFrame, now: str, source: str = "lead-enrichment") -> DataFrame:
    """Patches from enrichment rows: evidence with default source, confidence 0.70 and time; stage and provider states.

    Rows of the care niche carry no grade, so that the verifier's grade stays.
    """
    r = _resolved(rows, ENRICHMENT_ALIASES)
    t = lambda n: F.col(f"_t_{n}")
    checked = F.when(_cell(r, "last_enriched_at", "last_queued_at", "checked_at") != "", _cell(r, "last_enriched_at", "last_queued_at", "checked_at")).otherwise(now)
    confidence = F.when(_cell(r, "confidence_score") != "", _cell(r, "confidence_score")).otherwise("0.70")
    cells = _with_evidence({n: t(n) for n in ENRICHMENT_ALIASES}, F.lit(source), confidence, checked)
    for f, names in (("email_general", ("email_general_source", "email_source")), ("phone_main", ("phone_main_source",)), ("decision_maker_1_name", ("decision_maker_1_source", "managing_director_source"))):
        given = _cell(r, *names)
        cells[f"{f}_source"] = F.when(cells[f] == "", "").when(given != "", given).otherwise(source)
    care = (F.lower(_cell(r, "niche")) == "pflegebox") | (_cell(r, "care_lead_type") != "")
    for c in ("lead_grade", "lead_grade_reason"):
        cells[c] = F.when(care, "").otherwise(t(c))
    role = F.when(_cell(r, "managing_director", "managing_director_name") != "", "Geschaeftsfuehrer").when(_cell(r, "owner_name") != "", "Inhaber").otherwise("")
    cells["decision_maker_1_role"] = F.when(t("decision_maker_1_role") != "", t("decision_maker_1_role")).when(cells["decision_maker_1_name"] != "", role).otherwise("")
    blocked = truthy(t("do_not_contact"))
    manual = (cells["lead_grade"] == "Review") | (_cell(r, "compliance_status") == "manual_review")
    step, status = _cell(r, "next_enrichment_step", "next_action"), _cell(r, "enrichment_status", "compliance_status")
    cells |= {
        "manual_review_required": F.when(manual, "true").otherwise(""),
        "review_status": F.when(blocked, "do_not_contact").when(manual, "manual_review").otherwise(""),
        "pipeline_status": F.when(blocked, "do_not_contact").otherwise("enriched"),
        "enrichment_stage": F.when(step.startswith("clay_email_queue"), "clay_handoff_ready").when(status != "", status).otherwise("enriched"),
        "last_completed_step": F.lit("enrichment"),
        "last_completed_at": checked,
        "clay_status": F.when((t("clay_status") == "") & truthy(t("clay_needed")), "needed").otherwise(t("clay_status")),
        "domain_key": normalize_domain(t("domain_key")),
    }
    for p in ("firecrawl", "serper", "tavily"):
        used, error = truthy(_cell(r, f"{p}_used")), _cell(r, f"{p}_error")
        wanted = _cell(r, "provider_recommended") == p
        cells[f"{p}_needed"] = F.when(used, "false").when((error != "") | wanted, "true").otherwise("")
        cells[f"{p}_status"] = F.when(used, "done").when(error != "", "failed").when(wanted, "needed").otherwise("")
    return r.select("ord", *(c.alias(n) for n, c in cells.items()))


def handoff_patch(rows: DataFrame, now: str) -> DataFrame:
    """Patches from hand-off results; matched by lead_id alone."""
    r = _resolved(rows, HANDOFF_ALIASES)
    cells = _with_evidence({n: F.col(f"_t_{n}") for n in HANDOFF_ALIASES}, F.lit("clay"), F.lit("0.70"), F.lit(now))
    cells["domain_key"] = normalize_domain(F.col("_t_domain_key"))
    cells["clay_status"] = F.when(F.col("_t_clay_status") != "", F.col("_t_clay_status")).otherwise("done")
    cells |= {"clay_last_synced_at": F.lit(now), "clay_result_imported_at": F.lit(now)}
    return r.select("ord", *(c.alias(n) for n, c in cells.items()))


def import_and_merge(master: DataFrame, rows: DataFrame, patch: DataFrame | None, source: str, run_id: str, now: str, key: str = "domain_key") -> tuple[DataFrame, DataFrame]:
    """Upsert a table's rows (if it brings new leads) and apply its patches; returns the master and the counts.

    ``rows`` are list rows with domain_key and ord; ``patch`` comes from one of the functions above.
    """
    merged = upsert_leads(master, rows, source, run_id, now)
    counts = upsert_counts(rows, merged)
    out = merged.drop("is_created", "is_updated", "incoming_rows")
    if patch is not None:
        evidence = [f for f in EVIDENCE if f"{f}_confidence" in patch.columns]
        own = {f"{f}{s}" for f in evidence for s in ("", "_source", "_confidence", "_checked_at")}
        values = [c for c in patch.columns if c not in own and c not in ("ord", "lead_id", "domain_key", "domain")]
        out = apply_patches(out, patch, key, values, evidence).drop("is_patched")
    return out, counts
