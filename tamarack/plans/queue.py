"""The enrichment queue: from verified and review tables to rows with quality, scores and the next step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import legal_form, site_email, site_phone
from ..functions.values import bool_string, clean_text, company_name, has, lead_id, normalize_url, split_tokens
from ..operators.classify import desired_role, lead_quality, outreach_angle, pain_scores, technology_stack
from ..operators.facts import sanitized
from ..operators.merge import dedupe_leads
from ..operators.pages import html_text
from ..operators.search import search_score, signals, top_candidates
from ..sources.tables import conform
from .gates import Cells, handoff_eligibility, next_step

# Columns of the queue, in order, that later steps read or fill.
QUEUE_COLUMNS = ["lead_id", "domain", "source_url", "website_url", "company_name", "legal_name", "legal_form", "lead_quality", "vhd_fit_score", "is_shop", "is_woocommerce", "is_dach", "possible_shop_levers", "pain_summary", "why_relevant", "recommended_outreach_channel", "free_enrichment_status", "confidence_score", "imprint_parse_status", "free_enrichment_source_urls", "website_pages_checked", "enrichment_status", "next_enrichment_step", "waterfall_reason", "provider_recommended", "requires_external_provider", "entity_ambiguous", "decision_maker_ambiguous", "imprint_url", "contact_url", "managing_director_name", "managing_director_source", "general_email", "phone_main", "address", "firecrawl_used", "firecrawl_source_url", "firecrawl_markdown_chars", "firecrawl_confidence_score", "firecrawl_summary", "firecrawl_error", "serper_used", "serper_queries", "serper_result_urls", "serper_summary", "serper_confidence_score", "tavily_used", "tavily_queries", "tavily_result_urls", "tavily_answer", "tavily_summary", "tavily_confidence_score", "tavily_credits", "tavily_error", "research_note", "clay_eligible", "clay_reason", "clay_used", "personal_email", "email_verification_status", "email_source", "mutmassliche_einwilligung_reason", "gdpr_legal_basis_note", "compliance_status", "compliance_reason", "unsubscribe_required", "outreach_approved", "outreach_channel", "do_not_contact", "do_not_contact_reason", "next_action", "instantly_pushed", "source_bucket", "last_queued_at", "notes"]
# Columns that start as no, and columns of yes or no.
START_NO = ["firecrawl_used", "serper_used", "tavily_used", "clay_used", "outreach_approved", "instantly_pushed"]
YES_NO = ["is_shop", "is_woocommerce", "is_dach", "entity_ambiguous", "decision_maker_ambiguous", "unsubscribe_required", "do_not_contact"]


def union_buckets(verified: DataFrame, review: DataFrame) -> DataFrame:
    """Verified and review rows together, each with its bucket; verified rows come first in order."""
    a = verified.withColumns({"input_bucket": F.lit("verified"), "_side": F.lit(0)})
    b = review.withColumns({"input_bucket": F.lit("review"), "_side": F.lit(1)})
    both = a.unionByName(b, allowMissingColumns=True)
    # verified rows keep their numbers' order and stand before all review rows
    return both.withColumn("ord", F.col("ord").cast("long") * 2 + F.col("_side") * (1 << 60)).drop("_side")


def build_queue(verified: DataFrame, review: DataFrame, now: str, limit: int | None = None, enabled: dict[str, bool] | None = None, offset: int = 0) -> DataFrame:
    """One row per domain with quality, angle, eligibility and next step; extra columns stay behind the queue's own.

    ``limit`` and ``offset`` take a slice of the domains in input order.
    """
    rows = dedupe_leads(union_buckets(verified, review))
    if limit is not None or offset:
        rows = rows.orderBy("ord").offset(offset)
        rows = rows if limit is None else rows.limit(limit)
    columns = rows.columns
    name = company_name("company_name" if "company_name" in columns else F.lit(""), "title" if "title" in columns else F.lit(""), "domain")
    levers = split_tokens("possible_shop_levers", lower=True) if "possible_shop_levers" in columns else F.array().cast("array<string>")
    flag = lambda c: Cells(columns).yes(c)
    tracking = split_tokens("tracking_signals") if "tracking_signals" in columns else F.array().cast("array<string>")
    found = split_tokens("signals") if "signals" in columns else F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "lead_id": lead_id("domain"),
            "website_url": normalize_url(F.lit(""), "domain"),
            "company_name": name["name"],
            "lead_quality": lead_quality(columns),
            "overall_priority": pain_scores(columns)["overall_priority"],
            "why_relevant": F.when(F.size(levers) > 0, outreach_angle(levers)).otherwise(""),
            "technology_stack": technology_stack(flag("is_woocommerce"), found, tracking),
            "last_queued_at": F.lit(now),
        }
    )
    rows = rows.withColumn("desired_role", desired_role(F.col("overall_priority"), flag("is_woocommerce")))
    c = Cells(rows.columns)
    legal = sanitized("legal_name", c["legal_name"])
    rows = rows.withColumns(
        {
            "source_url": c.first("source_url", "url"),
            "legal_name": legal,
            "legal_form": F.when(legal == "", "").otherwise(F.coalesce(F.nullif(c["legal_form"], F.lit("")), legal_form(legal))),
            "pain_summary": F.when(F.size(levers) > 0, outreach_angle(levers)).otherwise(""),
            "managing_director_name": sanitized("managing_director_name", c.first("managing_director_name", "managing_director", "decision_maker_1_name")),
            "managing_director_source": c.first("managing_director_source", "decision_maker_1_source"),
            "general_email": c.first("general_email", "email_general", "email"),
            "phone_main": sanitized("phone_main", c.first("phone_main", "phone")),
            "personal_email": c.first("personal_email", "email_personal"),
            **{n: F.lit("false") for n in START_NO},
            **{n: bool_string(c.yes(n)) for n in YES_NO},
        }
    )
    out = decide(rows, enabled, QUEUE_COLUMNS)
    return out.withColumn("requires_external_provider", bool_string(has("provider_recommended")))


def decide(rows: DataFrame, enabled: dict[str, bool] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Queue rows with hand-off eligibility and next step taken anew, as after each enrichment."""
    c = Cells(rows.columns)
    rows = rows.withColumns({"_e": handoff_eligibility(c), "_n": next_step(c, enabled)})
    rows = rows.withColumns({"clay_eligible": F.when(F.col("_e.eligible"), "true").otherwise("false"), "clay_reason": F.col("_e.reason"), "next_enrichment_step": F.col("_n.next_step"), "enrichment_status": F.col("_n.status"), "provider_recommended": F.col("_n.provider"), "waterfall_reason": F.col("_n.reason")}).drop("_e", "_n")
    return conform(rows, columns) if columns else rows


def search_site_facts(results: DataFrame, pages: DataFrame, min_score: int, k: int) -> DataFrame:
    """The top candidates with the first address and number and the signals of their own pages, and their score taken anew.

    Pages (domain, url, html, fetch_order) are read one by one; what a result already has stays.
    """
    top = top_candidates(results, min_score, k)
    text = html_text("html")
    per_page = pages.join(top.select("domain").distinct(), "domain", "left_semi").select("domain", "fetch_order", site_email(text).alias("_email"), site_phone(text).alias("_phone"), signals(text, F.col("url")).alias("_signals"))
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("fetch_order"))), F.lit("")).alias(c)
    found = per_page.groupBy("domain").agg(pick("_email"), pick("_phone"), F.array_distinct(F.flatten(F.collect_set("_signals"))).alias("_signals"))
    out = top.join(found, "domain", "left")
    fill = lambda c: F.when(has(c), clean_text(c)).otherwise(F.coalesce(f"_{c}", F.lit("")))
    out = out.withColumns({"email": fill("email"), "phone": fill("phone"), "signals": F.array_union("signals", F.coalesce("_signals", F.array().cast("array<string>")))})
    out = out.withColumn("score", F.greatest(F.col("score"), search_score(F.col("signals"), F.col("email"), F.col("phone"))))
    return out.drop("_email", "_phone", "_signals")
