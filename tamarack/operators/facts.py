"""Facts of companies from their pages, search hits, scrapes and research answers, and their way onto the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.values import clean_text, filled, has, let
from .classify import points
from .pages import html_text


def with_identity(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Rows with identity and contact columns from one text column; company and person are found once for both their columns."""
    t = F.col(text)
    found = rows.withColumns({"_company": contacts.company_identity(t), "_who": contacts.decision_maker(t)})
    cells = {
        "legal_name": F.col("_company.legal_name"),
        "legal_form": F.col("_company.legal_form"),
        "managing_director_name": F.col("_who.name"),
        "managing_director_role": F.col("_who.role"),
        "address": contacts.address(t),
        "general_email": contacts.general_email(t),
        "phone_main": contacts.main_phone(t),
    }
    return found.withColumns({f"{prefix}{k}": v for k, v in cells.items()}).drop("_company", "_who")


def public_facts(pages: DataFrame, imprint_tokens: tuple[str, ...] = ("impressum", "imprint"), contact_tokens: tuple[str, ...] = ("kontakt", "contact")) -> DataFrame:
    """Facts of each domain from all its reachable pages (domain, url, status, html, fetch_order), with confidence and parse status.

    Facts are found page by page and then gathered by site: of each fact the first that is filled, from imprint pages before contact
    pages before others, in page order. A name and its form, and a person and their role, come from one page.
    """
    ok = pages.where((F.col("html") != "") & (F.col("status") >= 200) & (F.col("status") < 400))
    hit = lambda tokens: F.exists(F.array(*map(F.lit, tokens)), lambda t: F.lower("url").contains(t))
    kind = F.when(hit(imprint_tokens), 0).when(hit(contact_tokens), 1).otherwise(2)
    texts = ok.select("domain", "url", F.struct(kind.alias("kind"), "fetch_order").alias("place"), html_text("html").alias("text"))
    found = with_identity(texts, "text").drop("text")
    first = lambda value, filled_by: F.min_by(value, F.when(F.col(filled_by) != "", F.col("place")))
    pick = lambda value, filled_by=None: F.coalesce(first(value, filled_by or value), F.lit("")).alias(value)
    pairs = [("legal_name", "legal_name"), ("legal_form", "legal_name"), ("managing_director_name", "managing_director_name"), ("managing_director_role", "managing_director_name")]
    url = lambda k, name: F.coalesce(F.min_by("url", F.when(F.col("place.kind") == k, F.col("place"))), F.lit("")).alias(name)
    lone_form = F.coalesce(first("legal_form", "legal_form"), F.lit("")).alias("_form")
    facts = found.groupBy("domain").agg(*(pick(v, by) for v, by in pairs), lone_form, *(pick(c) for c in ("address", "general_email", "phone_main")), url(0, "imprint_url"), url(1, "contact_url"), F.count("*").alias("pages_used"))
    facts = facts.withColumn("legal_form", F.when(has("legal_name"), F.col("legal_form")).otherwise(F.col("_form"))).drop("_form")
    score = points((has("imprint_url"), 25), (has("legal_name"), 20), (has("managing_director_name"), 20), (has("general_email") | has("phone_main"), 15), (has("address"), 10))
    most_share = F.when(has("imprint_url"), 95).otherwise(75)
    confidence = F.least(most_share, 20 + score) / 100.0
    return facts.withColumn("confidence_score", confidence).withColumn("imprint_parse_status", F.when(F.col("confidence_score") >= 0.70, "complete").otherwise("low_confidence"))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def sanitized(name: str, value: Column) -> Column:
    """The value of a guarded column if it is plausible, else blank; other columns are cleaned only."""
    if name == "phone_main":
        return let(contacts.normalize_phone(clean_text(value)), lambda phone: F.when(contacts.plausible_phone(phone), phone).otherwise(""))
    if name == "managing_director_name":
        return let(contacts.clean_person_name(clean_text(value)), lambda person: F.when(contacts.plausible_person_name(person), person).otherwise(""))
    if name == "legal_name":

        def body(text: Column) -> Column:
            own = let(contacts.legal_form(text), lambda form: F.when((form != "") & contacts.plausible_legal_name(text, form), text))
            return F.coalesce(own, contacts.company_identity(text)["legal_name"])

        return let(clean_text(value), body)
    return clean_text(value)


def apply_facts(queue: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ("legal_name", "managing_director_name", "phone_main", "general_email", "imprint_url", "address")) -> DataFrame:
    """Facts onto queue rows by domain: a plausible stored value stays, else a plausible fact fills it; implausible ones are cleared.

    The company takes the legal name where it has none; confidence, parse status, free status and pages are set.
    """
    fresh = facts.select("domain", *(F.col(c).alias(f"_{c}") for c in columns), F.col("confidence_score").alias("_confidence"), F.col("imprint_parse_status").alias("_parse"), F.col("pages_used").alias("_pages"))
    out = queue.join(fresh, "domain", "left")
    met = F.col("_confidence").isNotNull()
    have = lambda c: F.col(c) if c in queue.columns else F.lit("")
    cells = {c: F.coalesce(blank_to_null(sanitized(c, have(c))), blank_to_null(sanitized(c, F.col(f"_{c}"))), F.lit("")) for c in columns}
    out = out.withColumns(cells)
    out = out.withColumns(
        {
            "company_name": F.coalesce(filled(have("company_name")), filled("legal_name"), F.lit("")),
            "confidence_score": F.when(met, F.format_string("%.2f", F.col("_confidence"))).otherwise(clean_text(have("confidence_score"))),
            "imprint_parse_status": F.when(met, F.col("_parse")).otherwise(clean_text(have("imprint_parse_status"))),
            "free_enrichment_status": F.when(met & (F.col("_confidence") >= 0.70), "complete").when(met, "low_confidence").otherwise("failed"),
            "pages_checked": F.coalesce("_pages", F.lit(0)),
        }
    )
    return out.drop(*(c for c in out.columns if c.startswith("_")))
