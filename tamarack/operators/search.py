"""Search results: ingest archived answers, filter, score, merge, and plan queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markers
from ..functions.contacts import site_email
from ..functions.values import clean_text, country_hint, filled, has, merge_signals, normalize_domain, same_domain, truthy
from ..sources.tables import cut
from .pages import html_text

# Parts of domains that searches should never bring in.
BLOCKED_PARTS = ["amazon.", "arboro.", "chip.", "conversionboosting.", "convert-gmbh.", "daswebsite.", "designers-inn.", "ebay.", "elsenmedia.", "etsy.", "facebook.", "fehler7.", "fuer-gruender.", "github.io", "github.", "google.", "haendlerbund.", "hb-ecommerce.", "heise.", "hosteurope.", "ihk.", "instagram.", "ionos.", "it-recht-kanzlei.", "itportal24.", "janolaw.", "kinsta.", "linkedin.", "linguee.", "marketpress.", "mbaierl.", "mediamarkt.", "mollie.", "omr.", "outvio.", "payone.", "pinterest.", "protectedshops.", "pons.", "raidboxes.", "rtl.", "ryte.", "secupay.", "sevdesk.", "shopify.", "shopware.com", "strato.", "stadtbranche.", "template", "tiktok.", "trustedshops.", "uptain.", "vendidero.", "websale.", "woocommerce.com", "woogency.", "wordpress.org", "wpbeginner.", "wpengine.", "youtube."]
# Words that say what a site is in its title; words of a shop; words of anything else.
IDENTITY_TERMS = ["agentur", "agency", "blog", "einrichten", "erstellen", "funktioniert nicht", "hosting", "kanzlei", "kassensystem", "leitfaden", "magazin", "payment", "plugin", "profis", "ratgeber", "rechtlichen voraussetzungen", "rechtssicher", "software", "shopware", "shopsystem", "template", "theme", "tutorial", "voraussetzungen", "webagentur", "webdesign", "zahlungsanbieter", "zahlungsmethoden"]
RESCUE_TERMS = ["in den warenkorb", "zur kasse", "versandkosten", "zahlungsarten", "lieferzeit"]
NON_SHOP_TERMS = ["agentur", "agency", "anwalt", "blog", "buchhaltung", "buchhaltungssoftware", "cookie", "datenschutzerkl", "datenschutzerklaerung", "datenschutzerklärung", "e-commerce agentur", "ecommerce agentur", "einrichten", "erstellen", "funktioniert nicht", "generator", "hosting", "hoster", "kanzlei", "kassensystem", "leitfaden", "magazin", "payment", "payment provider", "plugin", "plugins", "pos kassensystem", "praxistipp", "profis", "ratgeber", "rechtstexte", "rechtssicher", "rechtlichen voraussetzungen", "software", "shopware", "shopsystem", "template", "templates", "theme", "themes", "tutorial", "voraussetzungen", "webagentur", "webdesign", "wordpress agentur", "woocommerce agentur", "zahlungsanbieter", "zahlungsmethoden"]
# Signals of a search hit, and their weights.
SIGNALS = {
    "woocommerce": ["woocommerce", "wc-cart", "wp-content/plugins/woocommerce"],
    "cart_checkout": ["warenkorb", "kasse", "checkout", "in den warenkorb"],
    "tracking_ads": ["google ads", "ga4", "google tag manager", "gtm", "meta pixel"],
    "product_data": ["produktdaten", "google shopping", "merchant center"],
    "active_shop": ["versandkosten", "zahlungsarten", "lieferzeit", "retoure"],
    "wordpress": ["wordpress", "wp-content"],
    "imprint": ["impressum", "inhaber", "geschaeftsfuehrer", "geschaftsfuhrer"],
}
WEIGHTS = {"woocommerce": 35, "cart_checkout": 20, "active_shop": 15, "imprint": 10, "tracking_ads": 10, "product_data": 10, "wordpress": 5}


def is_blocked(domain: Column, parts: list[str] = BLOCKED_PARTS, own: tuple[str, ...] = ()) -> Column:
    own_site = domain.isin(list(own)) if own else F.lit(False)
    return (domain == "") | own_site | (markers.blocked_reason(domain, parts) != "")


def looks_like_non_shop(text: Column, url: Column, identity: list[str] = IDENTITY_TERMS, rescue: list[str] = RESCUE_TERMS, other: list[str] = NON_SHOP_TERMS) -> Column:
    """Identity words in the first 180 characters or the domain; else, without a shop's words, non-shop words anywhere."""
    area = F.concat_ws(" ", F.substring(F.lower(text), 1, 180), normalize_domain(url))
    every = F.lower(F.concat_ws(" ", text, url))
    return F.when(markers.any_term(area, identity), True).when(markers.any_term(every, rescue), False).otherwise(markers.any_term(every, other))


def signals(text: Column, url: Column, families: dict[str, list[str]] = SIGNALS) -> Column:
    """Labels of the signals that text and address hold, in the dictionary's order."""
    every = F.lower(F.concat_ws(" ", text, url))
    return F.array_compact(F.array(*(F.when(markers.any_term(every, terms), F.lit(label)) for label, terms in families.items())))


def search_score(labels: Column, email: Column, phone: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    """Sum of the labels' weights, 8 for an address and 5 for a number, 100 at most."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    total = F.aggregate(F.array_distinct(labels), F.lit(0), lambda a, x: a + F.coalesce(F.try_element_at(table, x), F.lit(0)))
    return F.least(F.lit(100), total + F.when(email != "", 8).otherwise(0) + F.when(phone != "", 5).otherwise(0))


HITS = "array<struct<url:string,link:string,title:string,description:string,snippet:string,extra_snippets:array<string>,profile:struct<name:string>>>"
#: Kinds of archived answers: the shape of their bodies, and what one must hold to be of use.
BODIES = {
    "search": (f"struct<web:struct<results:{HITS}>,items:{HITS}>", lambda p: F.coalesce(p["web"]["results"], p["items"])),
    "hits": ("struct<organic:array<struct<title:string,link:string,snippet:string,position:int>>>", lambda p: p["organic"]),
    "research": ("struct<query:string,answer:string,usage:struct<credits:int>,results:array<struct<title:string,url:string,content:string,score:double,raw_content:string>>>", lambda p: F.coalesce(p["query"], p["answer"], p["results"].cast("string"))),
    "scrapes": ("struct<success:boolean,data:struct<markdown:string,warning:string,metadata:struct<title:string,sourceURL:string,statusCode:int>>>", lambda p: p["data"]),
}


def parsed_bodies(responses: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``responses`` with the body as a struct ``_p`` instead of JSON text."""
    return responses.withColumn("_p", F.from_json(body, BODIES[kind][0])).drop(body)


def accept_bodies(responses: DataFrame, kind: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Archived answers that can be read, parsed as ``parsed_bodies`` does, and the others with their body and a ``reason``.

    Reasons: ``null``, ``blank``, ``malformed`` (no JSON), ``unexpected`` (JSON without what its kind must hold). The answers are
    read and parsed once; both results come from that one writing, in a folder each.
    """
    shape, needed = BODIES[kind]
    p = F.from_json(body, shape)
    rows = responses.withColumn("_p", p)
    held = needed(F.col("_p"))
    # from_json reads what it can of broken text, so whether it is JSON at all is asked of the strict parser; that stops after
    # the first value, so the text is put where nothing may follow it: no text but one value fits both in an array and in an object
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    reason = F.when(F.col(body).isNull(), "null").when(F.btrim(F.col(body), F.lit(" \t\r\n")) == "", "blank").when(~whole, "malformed").when(held.isNull(), "unexpected").otherwise("ok")
    rows = cut(rows.withColumns({"_reason": reason, body: F.when(reason != "ok", F.col(body))}), "bodies", "_reason")
    good = rows.where("_reason = 'ok'").drop("_reason", body)
    bad = rows.where("_reason != 'ok'").drop("_p").withColumnRenamed("_reason", "reason")
    return good, bad


def search_rows(answers: DataFrame) -> DataFrame:
    """One row per hit of parsed search answers, from ``web.results`` or ``items``.

    Markup is stripped, extra snippets are appended, and the company is the profile's name, else the title.
    """
    keep = [c for c in answers.columns if c != "_p"]
    rows = answers.select(*keep, F.posexplode(F.coalesce("_p.web.results", "_p.items")).alias("pos", "hit"))
    url = F.coalesce("hit.url", "hit.link", F.lit(""))
    text = F.concat_ws(" ", F.coalesce("hit.description", "hit.snippet"), F.array_join("hit.extra_snippets", " "))
    title = html_text("hit.title")
    domain = normalize_domain(url)
    out = rows.select(*keep, "pos", url.alias("url"), domain.alias("domain"), title.alias("title"), html_text(text).alias("snippet"), F.coalesce(filled("hit.profile.name"), title).alias("company_name"))
    labels = signals(F.concat_ws(" ", "title", "snippet"), F.col("url"))
    out = out.withColumns({"signals": labels, "email": site_email("snippet"), "country_hint": country_hint("domain")})
    return out.withColumn("score", search_score(F.col("signals"), F.col("email"), F.lit("")))


def hit_rows(answers: DataFrame) -> DataFrame:
    """Typed hits of parsed enrichment searches: without a link they are dropped, position defaults to index + 1."""
    keep = [c for c in answers.columns if c != "_p"]
    rows = answers.select(*keep, F.posexplode("_p.organic").alias("i", "h"))
    rows = rows.select(*keep, F.coalesce("h.title", F.lit("")).alias("title"), F.coalesce("h.link", F.lit("")).alias("link"), F.coalesce("h.snippet", F.lit("")).alias("snippet"), F.coalesce("h.position", F.col("i") + 1).alias("position"))
    return rows.where(F.col("link") != "")


def research_rows(answers: DataFrame) -> DataFrame:
    """Query, answer, credits (1 by default) and hits with title, url, content and score of parsed research answers."""
    return answers.select(*[c for c in answers.columns if c != "_p"], F.coalesce("_p.query", F.lit("")).alias("research_query"), F.coalesce("_p.answer", F.lit("")).alias("answer"), F.coalesce("_p.usage.credits", F.lit(1)).alias("credits"), F.filter(F.coalesce("_p.results", F.array()), lambda h: h["url"].isNotNull() & (h["url"] != "")).alias("hits"))


def scrape_rows(answers: DataFrame) -> DataFrame:
    """Markdown, source address, title, status and warning of parsed scrapes."""
    return answers.select(*[c for c in answers.columns if c != "_p"], F.coalesce("_p.data.markdown", F.lit("")).alias("markdown"), F.coalesce("_p.data.metadata.sourceURL", F.lit("")).alias("source_url"), F.coalesce("_p.data.metadata.title", F.lit("")).alias("title"), F.coalesce("_p.data.metadata.statusCode", F.lit(0)).alias("status_code"), F.coalesce("_p.data.warning", F.lit("")).alias("warning"))


def ingest_search_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Archived search answers (query, body as JSON) to one row per hit; bodies that can't be read give none (see ``accept_bodies``)."""
    return search_rows(parsed_bodies(responses, "search", body))


def ingest_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """Archived enrichment-search answers to typed hits; bodies that can't be read give none (see ``accept_bodies``)."""
    return hit_rows(parsed_bodies(responses, "hits", body))


def ingest_research(responses: DataFrame, body: str = "body") -> DataFrame:
    """Archived research answers; bodies that can't be read give blank ones (see ``accept_bodies``)."""
    return research_rows(parsed_bodies(responses, "research", body))


def ingest_scrapes(responses: DataFrame, body: str = "body") -> DataFrame:
    """Archived scrapes; bodies that can't be read give blank ones (see ``accept_bodies``)."""
    return scrape_rows(parsed_bodies(responses, "scrapes", body))


# Columns that a later search fills only where the stored row is blank.
SEARCH_FILL = ["url", "title", "snippet", "company_name", "email", "phone", "country_hint", "query"]


def merge_search_results(master: DataFrame, fresh: DataFrame, now: str) -> DataFrame:
    """Full outer merge by domain: stored values first, higher score, united signals, last seen replaced, ``is_new`` for new domains."""
    f = fresh.select(F.col("domain").alias("_d"), *(F.col(c).alias(f"_{c}") for c in fresh.columns if c != "domain"))
    joined = master.withColumn("_stored", F.lit(True)).join(f, master["domain"] == f["_d"], "full_outer")
    met = F.col("_d").isNotNull()
    out = {"domain": F.coalesce("domain", "_d")}
    for c in SEARCH_FILL:
        parts = [filled(n) for n in (c if c in master.columns else None, f"_{c}" if c in fresh.columns else None) if n]
        if parts:
            out[c] = F.coalesce(*parts, F.lit(""))
    out["score"] = F.greatest(F.coalesce("score", F.lit(0)), F.coalesce("_score", F.lit(0)))
    out["signals"] = merge_signals("signals", "_signals")
    out["last_seen"] = F.when(met, now).otherwise(clean_text("last_seen"))
    out["is_new"] = F.col("_stored").isNull()
    return joined.select(*(v.alias(k) for k, v in out.items()))


# Signals of which a qualified lead has one at least.
SHOP_SIGNALS = ["woocommerce", "cart_checkout", "active_shop"]


def qualified_leads(rows: DataFrame, min_score: int = 50, wanted: list[str] = SHOP_SIGNALS, parts: list[str] = BLOCKED_PARTS, words: tuple[list[str], list[str], list[str]] = (IDENTITY_TERMS, RESCUE_TERMS, NON_SHOP_TERMS)) -> DataFrame:
    """Rows that aren't blocked, don't look like anything but a shop, and have the score and a wanted signal (array ``signals``)."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    overlap = F.arrays_overlap("signals", F.array(*map(F.lit, wanted)))
    return rows.where(~is_blocked(F.col("domain"), parts) & ~looks_like_non_shop(text, F.col("url"), *words) & (F.col("score") >= min_score) & overlap)


def email_export(rows: DataFrame) -> DataFrame:
    """The five columns of the mailing hand-off, for rows with an address."""
    return rows.where(has("email")).select(F.col("email").alias("Email"), F.lit("").alias("First Name"), F.lit("").alias("Last Name"), F.col("company_name").alias("Company"), F.col("url").alias("Website"))


def top_candidates(rows: DataFrame, min_score: int, k: int, order: str = "ord") -> DataFrame:
    return rows.where(F.col("score") >= min_score).orderBy(order).limit(k)


def expand_templates(templates: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """Templates (idx, template) with each ``{name}`` replaced by each of its values: distinct queries in first-seen order, as idx and query."""
    rows = templates.select("template", F.array(F.col("idx").cast("long")).alias("place"))
    for name, options in values.items():
        # the options are a short parameter list: an array that is exploded beside the template
        has_slot = F.col("template").contains("{" + name + "}")
        each = F.when(has_slot, F.array(*map(F.lit, options))).otherwise(F.array(F.lit("")))
        rows = rows.select("template", "place", F.posexplode(each).alias("i", "v"))
        rows = rows.select(F.replace("template", F.lit("{" + name + "}"), F.col("v")).alias("template"), F.concat("place", F.array(F.col("i").cast("long"))).alias("place"))
    firsts = rows.groupBy(F.col("template").alias("query")).agg(F.min("place").alias("place"))
    return firsts.select((F.expr("row_number() OVER (ORDER BY place)") - 1).alias("idx"), "query")


# --- hits of enrichment searches -----------------------------------------------------------------


def plan_queries(queue: DataFrame, key: str = "lead_id") -> DataFrame:
    """One row per search query a lead's next step needs: key, purpose, qno (from 1) and query."""
    domain = normalize_domain(F.coalesce(filled("domain"), filled("website_url")))
    company = F.coalesce(filled("company_name"), filled("legal_name"), F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    named = company != ""
    imprint = F.array_compact(F.array(say("site:", domain, " impressum"), say('"', domain, '" impressum'), F.when(named, say('"', company, '" Impressum'))))
    person = F.array_compact(F.array(say("site:", domain, ' "Geschäftsführer"'), F.when(named, say('"', company, '" Geschäftsführer')), F.when(named, say('"', company, '" Inhaber')), say("site:", domain, ' "Vertreten durch"')))
    step = clean_text("next_enrichment_step")
    purpose = F.when(step.contains("find_imprint"), "imprint").when(step.contains("find_decision_maker"), "decision_maker").otherwise("")
    queries = F.when(purpose == "imprint", imprint).when(purpose == "decision_maker", person).otherwise(F.array().cast("array<string>"))
    rows = queue.select(key, purpose.alias("purpose"), F.posexplode(queries).alias("i", "query"))
    return rows.select(key, "purpose", (F.col("i") + 1).alias("qno"), "query")


def plan_research() -> dict[str, Column]:
    """The research query of a row that is unclear, and what it is about; blank where there is nothing to ask."""
    domain = normalize_domain(F.coalesce(filled("domain"), filled("website_url")))
    name = F.coalesce(filled("company_name"), filled("legal_name"), domain)
    # The words of the two queries.
    entity = F.trim(F.concat(F.lit('"'), name, F.lit('" Betreiber Firma Impressum Geschäftsführer '), domain))
    person = F.trim(F.concat(F.lit('"'), name, F.lit('" Geschäftsführer Inhaber Vertreten durch '), domain))
    about = F.when(truthy("entity_ambiguous"), "entity").when(truthy("decision_maker_ambiguous"), "decision_maker").when(clean_text("next_enrichment_step").contains("ambiguous_entity"), "entity").otherwise("")
    return {"query": F.when(about == "entity", entity).when(about == "decision_maker", person).otherwise(""), "purpose": about}


def summarize_hits(hits: DataFrame, key: str, order: str = "position", most: int = 3, width: int = 220) -> DataFrame:
    """For each key its first hits as ``title: snippet``, cut and joined; and its distinct links in order.

    Only the first ``most`` hits are gathered for the summary; the links are all of the key's.
    """
    ranked = hits.withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {order})"))
    part = F.struct("_rank", F.substring(clean_text(F.concat_ws(": ", "title", "snippet")), 1, width).alias("text"))
    grouped = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, part))).alias("parts"), F.array_sort(F.collect_list(F.struct("_rank", "link"))).alias("links"))
    links = F.array_distinct(F.filter(F.transform("links", lambda x: x["link"]), lambda x: x.isNotNull() & (x != "")))
    return grouped.select(key, F.array_join(F.filter(F.transform("parts", lambda x: x["text"]), lambda x: x != ""), " | ").alias("summary"), F.array_join(links, "|").alias("links"))


# Words of an imprint.
IMPRINT_TOKENS = ["impressum", "imprint", "anbieterkennzeichnung"]


def imprint_hit(link: Column, title: Column, snippet: Column, domain: Column) -> Column:
    """Whether a hit on the lead's own domain names an imprint."""
    every = F.lower(F.concat_ws(" ", link, title, snippet))
    return markers.any_term(every, IMPRINT_TOKENS) & ((domain == "") | same_domain(link, domain))
