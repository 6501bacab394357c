"""The single-pass enrichment: a lead row and its site's facts become one row of 48 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bool_string, clean_text, company_name, format_confidence, lead_id, normalize_domain, normalize_url, split_tokens
from ..operators.classify import desired_role, outreach_angle, pain_scores, technology_stack
from .gates import Cells, gdpr_note, outreach_gate

# The columns of an enriched lead, in order.
ENRICHED_COLUMNS = ["lead_id", "domain", "website_url", "company_name", "company_name_source", "company_name_confidence", "legal_name", "legal_form", "street", "zip", "city", "country", "imprint_url", "register_source", "register_number", "managing_director", "owner_name", "decision_maker_1_name", "decision_maker_1_role", "decision_maker_1_source", "decision_maker_1_confidence", "linkedin_company_url", "linkedin_person_url", "phone_main", "phone_main_source", "email_general", "email_general_source", "email_personal", "email_personal_source", "contact_form_url", "technology_stack", "woocommerce_detected", "wordpress_detected", "shop_relevance_score", "technical_pain_score", "conversion_pain_score", "business_potential_score", "overall_priority", "recommended_outreach_channel", "outreach_angle", "mutmassliche_einwilligung_reason", "gdpr_legal_basis_note", "compliance_status", "do_not_contact", "do_not_contact_reason", "last_enriched_at", "next_action", "notes"]
FACTS = ["legal_name", "legal_form", "imprint_url", "contact_url", "managing_director_name", "managing_director_role", "general_email", "phone_main", "decision_source", "decision_confidence"]


def outreach_channel(priority: Column, phone: Column, email: Column) -> Column:
    return F.when(priority.isin("A", "B"), F.when(phone != "", "phone_main").otherwise("manual_linkedin_research")).when(email != "", "manual_review_generic_email_only").otherwise("manual_review")


def consent_reason(priority: Column, angle: Column, channel: Column, is_woocommerce: Column, offer: str) -> Column:
    """Why contact is presumed welcome; blank below priority B. ``offer`` is the sender's own sentence."""
    context = F.when(is_woocommerce, "WooCommerce shop").otherwise("verified shop")
    text = F.concat(context, F.lit(" with documented shop optimization lever: "), angle, F.lit(f" {offer} business-specific relevance exists; first contact channel recommended: "), channel, F.lit("."))
    return F.when(priority.isin("A", "B"), text).otherwise("")


def single_pass(rows: DataFrame, now: str, facts: DataFrame | None = None, offer: str = "Technical growth optimization is offered;") -> DataFrame:
    """``rows`` of leads to ENRICHED_COLUMNS, one for one.

    ``facts`` has one row for each domain, as ``public_facts`` makes them (missing columns count as blank); they are used for
    leads of priority A and B only. What the lead row states itself stays, but for a company name of less confidence than an imprint's.
    """
    rows = rows.select(*(clean_text(n).alias(n) for n in rows.columns))
    c = Cells(rows.columns, cleaned=True)
    domain = normalize_domain(c.first("domain", "source_url", "url"))
    # what several cells name is a column first, evaluated once
    scores = pain_scores(rows.columns)
    r = rows.withColumns({"_domain": domain, "_priority": scores.pop("overall_priority"), **{f"_{n}": s for n, s in scores.items()}, "_angle": outreach_angle(split_tokens(c["possible_shop_levers"], lower=True))})
    r = r.withColumn("_named", company_name(c["company_name"], c["title"], F.col("_domain")))
    own = [f for f in FACTS if facts is not None and f in facts.columns]
    if own:
        r = r.join(facts.select(normalize_domain("domain").alias("_domain"), *(clean_text(f).alias(f"_f_{f}") for f in own)), "_domain", "left")
    wanted = F.col("_priority").isin("A", "B") & (F.col("_domain") != "")
    fact = {f: F.when(wanted, F.coalesce(f"_f_{f}", F.lit(""))).otherwise("") if f in own else F.lit("") for f in FACTS}

    angle, priority, named = F.col("_angle"), F.col("_priority"), F.col("_named")
    by_imprint = (fact["legal_name"] != "") & (named["confidence"] < 0.95)
    signals = F.array_join(F.concat(split_tokens(c["verified_signals"]), split_tokens(c["signals"])), " ")
    woocommerce = c.yes("is_woocommerce") | F.array_join(F.concat(split_tokens(c["woocommerce_signals"]), split_tokens(c["verified_signals"])), " ").contains("woocommerce")
    director = F.when(fact["managing_director_role"] == "Inhaber", "").otherwise(fact["managing_director_name"])
    owner = F.when(fact["managing_director_role"] == "Inhaber", fact["managing_director_name"]).otherwise("")
    person = fact["managing_director_name"]
    email = F.when(c["email"] != "", c["email"]).otherwise(fact["general_email"])
    phone = F.when(c["phone"] != "", c["phone"]).otherwise(fact["phone_main"])
    source = lambda given, found, what: F.when(given != "", f"input_csv:{what}").when(found != "", "website_public_page").otherwise("")
    r = r.withColumns({"_phone": phone, "_email": email})
    phone, email = F.col("_phone"), F.col("_email")
    how = outreach_channel(priority, phone, email)
    concrete = (angle != "") & priority.isin("A", "B")
    r = r.withColumn("_gate", outreach_gate(priority, phone != "", F.lit(False), priority.isin("A", "B", "C", "Review"), concrete, c["exclusion_reason"] != ""))
    gate = F.col("_gate")
    reason = consent_reason(priority, angle, how, woocommerce, offer)
    stated = F.upper(c.first("country", "country_hint"))
    notes = F.array(c["notes"], gate["reason"], F.when(c["possible_shop_levers"] != "", F.concat(F.lit("source_levers="), c["possible_shop_levers"])).otherwise(""))
    cells = {
        "lead_id": lead_id("_domain"),
        "domain": F.col("_domain"),
        "website_url": normalize_url(c.first("source_url", "url"), "_domain"),
        "company_name": F.when(by_imprint, fact["legal_name"]).otherwise(named["name"]),
        "company_name_source": F.when(by_imprint, "website_imprint").otherwise(named["source"]),
        "company_name_confidence": format_confidence(F.when(by_imprint, 0.95).otherwise(named["confidence"])),
        "legal_name": fact["legal_name"],
        "legal_form": fact["legal_form"],
        "country": F.when(stated != "", stated).when(c.yes("is_dach"), "DACH").otherwise(""),
        "imprint_url": fact["imprint_url"],
        "managing_director": director,
        "owner_name": owner,
        "decision_maker_1_name": person,
        "decision_maker_1_role": F.when(director != "", "Geschaeftsfuehrer").when(owner != "", "Inhaber").otherwise(desired_role(priority, c.yes("is_woocommerce"))),
        "decision_maker_1_source": fact["decision_source"],
        "decision_maker_1_confidence": F.when(fact["decision_confidence"] == "", "").otherwise(format_confidence(fact["decision_confidence"])),
        "phone_main": phone,
        "phone_main_source": source(c["phone"], fact["phone_main"], "phone"),
        "email_general": email,
        "email_general_source": source(c["email"], fact["general_email"], "email"),
        "contact_form_url": fact["contact_url"],
        "technology_stack": technology_stack(c.yes("is_woocommerce"), F.array(signals), split_tokens(c["tracking_signals"])),
        "woocommerce_detected": bool_string(woocommerce),
        "wordpress_detected": bool_string(signals.contains("wordpress")),
        **{n: F.col(f"_{n}").cast("string") for n in ("shop_relevance_score", "technical_pain_score", "conversion_pain_score", "business_potential_score")},
        "overall_priority": priority,
        "recommended_outreach_channel": how,
        "outreach_angle": angle,
        "mutmassliche_einwilligung_reason": F.when((gate["status"] != "outreach_ready") & (reason == ""), "Not ready for outreach; manual relevance and channel review required.").otherwise(reason),
        "gdpr_legal_basis_note": gdpr_note(person != "", "B2B lead review"),
        "compliance_status": gate["status"],
        "do_not_contact": bool_string(gate["do_not_contact"]),
        "do_not_contact_reason": F.when(gate["do_not_contact"], gate["reason"]).otherwise(""),
        "last_enriched_at": F.lit(now),
        "next_action": gate["next_action"],
        "notes": F.array_join(F.filter(notes, lambda n: n != ""), " | "),
    }
    return r.select(*(cells.get(n, F.lit("")).alias(n) for n in ENRICHED_COLUMNS))
