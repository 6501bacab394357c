"""Planning and gates: which step a lead takes next, and whether anyone may contact it.

All are ordered CASE expressions: the first rule that holds decides. ``row`` maps column names to cleaned text
columns; names that a table doesn't have count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bool_string, clean_text, confidence_percent, first_filled, first_valid_confidence, quality_rank, truthy, valid_email

Row = dict[str, Column]


class Cells:
    """Cleaned text columns of a table by name; blank where the table has none. ``cleaned``: the table's columns are so already."""

    def __init__(self, columns: list[str], cleaned: bool = False):
        self.columns = set(columns)
        self.cleaned = cleaned

    def __getitem__(self, name: str) -> Column:
        return F.lit("") if name not in self.columns else F.col(name) if self.cleaned else clean_text(name)

    def has(self, *names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (self[n] != "")
        return out

    def yes(self, name: str) -> Column:
        return truthy(self[name]) if name in self.columns else F.lit(False)

    def first(self, *names: str) -> Column:
        found = [n for n in names if n in self.columns]
        return first_filled(*found) if found else F.lit("")


def worthy(c: Cells) -> Column:
    return quality_rank(c["lead_quality"]) >= 2


def handoff_eligibility(c: Cells) -> Column:
    """struct(eligible, reason) by eight rules in order."""
    out = lambda ok, reason: F.struct(F.lit(ok).alias("eligible"), F.lit(reason).alias("reason"))
    return (
        F.when(c["lead_quality"] != "A++", out(False, "Lead is not A++."))
        .when(~c.yes("is_woocommerce"), out(False, "Lead is not confirmed WooCommerce."))
        .when(~c.has("company_name"), out(False, "Company name is missing."))
        .when(~c.has("managing_director_name"), out(False, "Managing director or owner is missing."))
        .when(c.has("personal_email"), out(False, "Personal email already present."))
        .when(~c.has("why_relevant", "pain_summary"), out(False, "Relevance note is missing."))
        .when(c.yes("do_not_contact"), out(False, "Lead is marked do-not-contact."))
        .otherwise(out(True, "A++ lead is eligible for Clay email enrichment queue."))
    )


# States after which the free enrichment counts as done.
FREE_DONE = ["complete", "website_enriched", "low_confidence", "failed"]


def next_step(c: Cells, enabled: dict[str, bool] | None = None) -> Column:
    """struct(next_step, status, reason, provider, external): the waterfall's decision; disabled providers are planned only."""
    enabled = enabled or {}

    def out(step: str, status: str, reason: str) -> Column:
        return F.struct(F.lit(step).alias("next_step"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit("").alias("provider"), F.lit(False).alias("external"))

    def provider(name: str, step: str, reason: str) -> Column:
        on = enabled.get(name, False)
        status = "queued_provider_enrichment" if on else "provider_disabled"
        text = reason if on else f"{reason} Provider '{name}' is disabled by policy."
        return F.struct(F.lit(step if on else f"{step}_planned").alias("next_step"), F.lit(status).alias("status"), F.lit(text).alias("reason"), F.lit(name).alias("provider"), F.lit(True).alias("external"))

    weak = c["imprint_parse_status"].isin("failed", "low_confidence") | (confidence_percent(c["confidence_score"], 100) < 70)
    unclear = c.yes("entity_ambiguous") | c.yes("decision_maker_ambiguous")
    return (
        F.when(~worthy(c), out("store_only", "queued_low_priority", "Lead quality is below A; no external enrichment or Clay."))
        .when(~c["free_enrichment_status"].isin(FREE_DONE), out("free_website_enrichment", "queued_free_enrichment", "Run own website/imprint extraction before any provider."))
        .when(~c.has("imprint_url"), provider("serper", "serper_find_imprint", "Imprint URL is missing after free enrichment."))
        .when(weak & c.yes("firecrawl_used"), out("manual_review", "queued_manual_review", "Firecrawl already ran; low-confidence result needs manual review."))
        .when(weak, provider("firecrawl", "firecrawl_extract_known_url", "Known imprint/contact URL exists, but local extraction confidence is low."))
        .when(~c.has("managing_director_name"), provider("serper", "serper_find_decision_maker", "Decision maker is missing after free enrichment."))
        .when(unclear & c.yes("tavily_used"), out("manual_review", "queued_manual_review", "Tavily research completed; ambiguous company or decision-maker evidence needs manual review."))
        .when(unclear, provider("tavily", "tavily_research_ambiguous_entity", "Company or decision maker is ambiguous and needs research summary."))
        .when(handoff_eligibility(c)["eligible"], provider("clay", "clay_email_queue", "A++ lead is eligible for Clay email enrichment queue."))
        .otherwise(out("compliance_review", "queued_compliance_review", "Free enrichment is sufficient for review; Clay is not required."))
    )


def plan_enrichment(leads: DataFrame) -> DataFrame:
    """lead_id with the plan of its enrichment: which of three providers it needs, and why."""
    c = Cells(leads.columns)
    blocked = c.yes("do_not_contact")
    high, top = c["lead_grade"].isin("A++", "A+", "A"), c["lead_grade"].isin("A++", "A+")
    no_one = ~c.has("decision_maker_1_name")
    scrape = ~c.has("legal_name") | ~c.has("imprint_url") | ~c.has("email_general") | ~c.has("phone_main")
    search, research = high & no_one, top & no_one
    actions = F.array_compact(F.array(F.when(scrape, "website_or_firecrawl_enrichment"), F.when(search, "serper_decision_maker_research"), F.when(research, "tavily_manual_research_brief")))
    pick = lambda yes, no: F.when(blocked, yes).otherwise(no)
    out = {
        "enrichment_stage": pick("blocked", "planned"),
        "next_action": pick("none", F.when(F.size(actions) == 0, "review_gate").otherwise(F.array_join(actions, "|"))),
        "next_action_reason": pick("Lead is marked do-not-contact.", "Missing firm/contact/decision-maker fields after CSV import."),
    }
    reasons = {"firecrawl": ("Missing website/imprint/contact fields.", "Required fields already present."), "serper": ("High-priority lead lacks decision maker.", "No automatic Serper step required."), "tavily": ("A++/A+ decision-maker research needs manual-quality brief.", "No automatic Tavily step required.")}
    for name, need in (("firecrawl", scrape), ("serper", search), ("tavily", research)):
        yes, no = reasons[name]
        out |= {f"{name}_needed": bool_string(~blocked & need), f"{name}_status": pick("blocked", F.when(need, "needed").otherwise("not_needed")), f"{name}_reason": pick("", F.when(need, yes).otherwise(no))}
    return leads.select(c["lead_id"].alias("lead_id"), *(v.alias(k) for k, v in out.items()))


# Hand-off states in which a lead is under way.
HANDOFF_ACTIVE = ["queued", "running", "done", "partial"]


def handoff_decision(c: Cells) -> Column:
    """struct(needed, reason) by grade."""
    out = lambda ok, reason: F.struct(F.lit(ok).alias("needed"), F.lit(reason).alias("reason"))
    g = c["lead_grade"]
    return (
        F.when(c.yes("do_not_contact"), out(False, "Lead is marked do-not-contact."))
        .when(g == "Reject", out(False, "Rejected leads never go to Clay."))
        .when(g == "Review", out(False, "Review leads require manual decision before Clay."))
        .when(g.isin("B", "C"), out(False, "B/C leads are not automatically sent to Clay."))
        .when(g == "A++", out(True, "A++ lead always goes to Clay in phase 1."))
        .when((g == "A+") & ~c.has("decision_maker_1_name"), out(True, "A+ lead is missing a decision maker."))
        .when((g == "A+") & ~c.has("email_general", "phone_main"), out(True, "A+ lead has no business contact path."))
        .when(g == "A+", out(True, "A+ lead is call-ready and stays on the queue."))
        .when(g == "A", out(True, "A lead goes to Clay during the start phase."))
        .otherwise(out(False, "Lead grade is not eligible for automatic Clay handoff."))
    )


def handoff_queue(leads: DataFrame, batch: str, now: str, again: bool = False) -> DataFrame:
    """Leads with the hand-off's decision: ``queued`` rows go out, ``patched`` rows get a new status; active ones stay untouched."""
    c = Cells(leads.columns)
    decision = handoff_decision(c)
    active = c["clay_status"].isin(HANDOFF_ACTIVE)
    queued = decision["needed"] & (F.lit(again) | ~active)
    dropped = ~decision["needed"] & c["clay_status"].isin("", "not_needed")
    channel = F.when(c.has("recommended_outreach_channel"), c["recommended_outreach_channel"]).when(c.has("phone_main"), "phone").when(c.has("email_general"), "email_review").when(c.has("linkedin_company_url"), "manual_linkedin_company_review").otherwise("clay_enrich_first")
    angle = F.when(c.has("outreach_angle"), c["outreach_angle"]).when(c["lead_grade"].isin("A++", "A+"), "Prioritize a concrete WooCommerce growth lever before outreach.").otherwise("Review shop fit and define the most concrete WooCommerce lever.")
    return leads.withColumns(
        {
            "handoff_channel": channel,
            "handoff_angle": angle,
            "handoff_queued": queued,
            "handoff_patched": queued | dropped,
            "handoff_reason": decision["reason"],
            "handoff_status": F.when(queued, "queued").when(dropped, "not_needed").otherwise(c["clay_status"]),
            "handoff_batch": F.when(queued, batch).otherwise(c["clay_export_batch_id"]),
            "handoff_at": F.when(queued, now).otherwise(c["clay_exported_at"]),
        }
    )


# Verification states of an address that may be used.
VERIFIED = ["verified", "valid", "deliverable"]


def email_ready(c: Cells) -> Column:
    """Approved, not blocked, channel e-mail, and a valid and verified address."""
    return c.yes("outreach_approved") & ~c.yes("do_not_contact") & (c.first("outreach_channel", "recommended_outreach_channel") == "email") & valid_email(c["personal_email"]) & F.lower(c["email_verification_status"]).isin(VERIFIED)


def step_pending(c: Cells) -> Column:
    step = c["next_enrichment_step"]
    handoff = step.startswith("clay_email_queue")
    return (
        F.when(step.isin("", "compliance_review", "manual_review", "store_only"), False)
        .when(handoff, ~c.has("personal_email"))
        .when(step.endswith("_planned"), True)
        .otherwise(c["provider_recommended"].isin("serper", "firecrawl", "tavily", "clay"))
    )


def channel(c: Cells) -> Column:
    return F.when(c.has("personal_email") & c.yes("outreach_approved"), "email").when(c.has("phone_main"), "call").when(c.has("linkedin_person_url"), "linkedin").otherwise("manual_review")


def gdpr_note(personal: Column, purpose: str) -> Column:
    return F.when(personal, f"Art. 6(1)(f) GDPR legitimate-interest review required; process only business-relevant data needed for {purpose}; keep source evidence and allow manual review before outreach.").otherwise(
        "Company-level enrichment only; if personal data is added later, perform Art. 6(1)(f) GDPR legitimate-interest balancing and keep data minimised."
    )


def consent_note(c: Cells, how: Column, offer: str) -> Column:
    """Why contact is presumed welcome; only for leads of grade A or better. ``offer`` is the sender's own sentence."""
    context = F.when(c.yes("is_woocommerce"), "WooCommerce shop").otherwise("verified shop")
    text = F.concat(context, F.lit(" with documented shop optimization lever: "), c.first("why_relevant", "pain_summary"), F.lit(f" {offer} business-specific relevance exists; first contact channel recommended: "), how, F.lit("."))
    return F.when(quality_rank(c["lead_quality"]) >= 1, text).otherwise("Not ready for outreach; manual relevance, channel, and legal-basis review required.")


def final_status(c: Cells) -> Column:
    """struct(status, reason) by eleven rules in order."""
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    ready = email_ready(c)
    context = c.yes("is_shop") | c.yes("is_woocommerce") | worthy(c)
    confidence = first_valid_confidence(*(c[n] for n in ("confidence_score", "firecrawl_confidence_score", "serper_confidence_score", "tavily_confidence_score")))
    stated = c.first("do_not_contact_reason")
    return (
        F.when(c.yes("do_not_contact"), out("do_not_contact", F.when(stated != "", stated).otherwise("Lead is marked do-not-contact.")))
        .when(~context, out("do_not_contact", "B2B/shop context is not sufficiently clear."))
        .when(~worthy(c), out("do_not_contact", "Lead quality is below enrichment threshold."))
        .when(step_pending(c), out("manual_review", "Provider or manual enrichment step is still pending."))
        .when(confidence < 0.70, out("manual_review", "Source confidence is below 0.70; manual evidence review required."))
        .when(~c.has("why_relevant", "pain_summary", "outreach_angle"), out("manual_review", "Concrete WooCommerce/shop relevance note is missing."))
        .when(c.has("personal_email") & ~ready, out("manual_review", "Personal email is present; explicit approval and verified status are required."))
        .when(c.has("phone_main"), out("outreach_ready", "Phone-first outreach review is ready with concrete B2B relevance."))
        .when(c.has("linkedin_person_url"), out("outreach_ready", "Manual LinkedIn outreach review is ready with concrete B2B relevance."))
        .when(ready, out("outreach_ready", "Email export is explicitly approved and verified for manual upload."))
        .otherwise(out("manual_review", "No conservative contact channel is ready."))
    )


def final_gate(queue: DataFrame, offer: str = "Technical growth optimization is offered;") -> DataFrame:
    """Queue rows with channel, notes, status, reason and action; the only path into an outreach bucket."""
    c = Cells(queue.columns)
    how = F.when(c.has("outreach_channel"), c["outreach_channel"]).otherwise(channel(c))
    staged = queue.withColumns(
        {
            "outreach_channel": how,
            "recommended_outreach_channel": F.when(c.has("recommended_outreach_channel"), c["recommended_outreach_channel"]).otherwise(how),
            "gdpr_legal_basis_note": F.when(c.has("gdpr_legal_basis_note"), c["gdpr_legal_basis_note"]).otherwise(gdpr_note(c.has("managing_director_name", "personal_email"), "B2B lead enrichment and manual outreach review")),
            "mutmassliche_einwilligung_reason": F.when(c.has("mutmassliche_einwilligung_reason"), c["mutmassliche_einwilligung_reason"]).otherwise(consent_note(c, how, offer)),
            "unsubscribe_required": bool_string((how == "email") | c.has("personal_email")),
        }
    )
    c = Cells(staged.columns)
    staged = staged.withColumn("_final", final_status(c))
    status = F.col("_final.status")
    blocked = status == "do_not_contact"
    staged = staged.withColumns({"compliance_status": status, "compliance_reason": F.col("_final.reason"), "do_not_contact": bool_string(blocked), "do_not_contact_reason": F.when(blocked, F.col("_final.reason")).otherwise("")})
    c = Cells(staged.columns)
    action = (
        F.when(blocked, "do_not_contact")
        .when(email_ready(c), "manual_instantly_upload")
        .when((status == "outreach_ready") & (c["outreach_channel"] == "call"), "manual_call_review")
        .when((status == "outreach_ready") & (c["outreach_channel"] == "linkedin"), "manual_linkedin_review")
        .otherwise("manual_compliance_review")
    )
    return staged.withColumns({"next_action": action, "instantly_ready": email_ready(c), "instantly_pushed": bool_string(c.yes("instantly_pushed"))}).drop("_final")


def outreach_gate(priority: Column, phone: Column, personal: Column, context: Column, angle: Column, blocked: Column) -> Column:
    """struct(status, do_not_contact, reason, next_action) of the single-pass enrichment."""
    out = lambda status, stop, reason, action: F.struct(F.lit(status).alias("status"), F.lit(stop).alias("do_not_contact"), F.lit(reason).alias("reason"), F.lit(action).alias("next_action"))
    return (
        F.when(blocked | (priority == "Reject"), out("do_not_contact", True, "Lead is rejected, excluded, or has a do-not-contact signal.", "do_not_contact"))
        .when(~context, out("do_not_contact", True, "B2B/shop context is not sufficiently clear.", "do_not_contact"))
        .when(personal, out("manual_review", False, "Personal email present; manual legal and relevance review required before use.", "manual_review"))
        .when(priority.isin("A", "B") & phone & angle, out("outreach_ready", False, "A/B lead with concrete shop relevance and phone-first channel.", "manual_call_review"))
        .otherwise(out("manual_review", False, "Lead needs manual review before outreach readiness.", "manual_review"))
    )


def run_counts(rows: DataFrame, status: str = "compliance_status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def run_states(log: DataFrame, order: str = "ord") -> DataFrame:
    """Latest state of each run from an append-only log (run_id, ts, ord, ...), and when it started.

    The entry of the greatest ordinal is the latest, whatever the entries' times and states are: times of whole seconds tie.
    """
    rest = [c for c in log.columns if c not in ("run_id", order)]
    last, first = F.max_by(F.struct(*rest), order).alias("s"), F.min_by("ts", order).alias("started_at")
    return log.groupBy("run_id").agg(last, first).select("run_id", "started_at", *(F.col(f"s.{c}").alias(c) for c in rest))
