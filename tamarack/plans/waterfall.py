"""The provider waterfall: search hits, scrapes and research answers meet the queue, round after round.

In each round each enabled provider, in order, serves the rows queued for it as far as its budget goes; the facts go onto the rows
and every row is decided anew, so a row may wait for the next provider in the same round. Answers are tables
of archived responses: what a live service would return for a row is joined to it by lead_id. A row without an
answer is a failed request.

Budgets: search grants the queries that are left, a row's need at most; scraping costs one page for each row with a known
address of its own; research runs a row while credits are left, so its last row may overshoot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.values import bool_string, clean_text, filled, has, let, normalize_domain, parse_confidence, truthy
from ..operators.budget import credit_budget, query_budget, query_cap, row_budget
from ..operators.classify import points
from ..operators.facts import blank_to_null, sanitized, with_identity
from ..operators.search import imprint_hit, plan_queries, plan_research, summarize_hits
from ..sources.tables import conform, cut, discard
from .queue import QUEUE_COLUMNS, decide

PROVIDERS = ("serper", "firecrawl", "tavily")
GUARDED = ("legal_name", "managing_director_name", "phone_main")


def queued_for(provider: str) -> Column:
    """Rows recommended to the provider, or whose next step begins with its name."""
    return (clean_text("provider_recommended") == provider) | clean_text("next_enrichment_step").startswith(f"{provider}_")


def needs_review() -> Column:
    """Rows that a person should look at after an enrichment."""
    return (clean_text("enrichment_status") == "provider_disabled") | clean_text("free_enrichment_status").isin("low_confidence", "failed")


def merged(name: str, stored: Column, fresh: Column) -> Column:
    """A plausible stored value stays, else a plausible fresh one, else blank."""
    return F.coalesce(blank_to_null(sanitized(name, stored)), blank_to_null(sanitized(name, fresh)), F.lit(""))


def overwritten(name: str, stored: Column, fresh: Column) -> Column:
    """A plausible fresh value replaces what is stored, else a plausible stored one stays, else blank."""
    return F.coalesce(blank_to_null(sanitized(name, fresh)), blank_to_null(sanitized(name, stored)), F.lit(""))


def two_places(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _domain() -> Column:
    return normalize_domain(F.coalesce(filled("domain"), filled("website_url")))


def apply_search(queue: DataFrame, hits: DataFrame, budget: int) -> DataFrame:
    """Search answers (lead_id, qno, position, title, link, snippet) onto the rows queued for search; ``paid`` is the number of queries used."""
    hits = hits.select("lead_id", "qno", "position", "title", "link", "snippet")
    planned = plan_queries(queue.where(queued_for("serper")))
    per_lead = planned.groupBy("lead_id", "purpose").agg(F.count("*").alias("n_planned"), F.array_sort(F.collect_list(F.struct("qno", "query"))).alias("queries"))  # four queries at most
    own = queue.select("lead_id", _domain().alias("own_domain"))
    answers = hits.join(planned.select("lead_id", "qno", "purpose"), ["lead_id", "qno"]).join(own, "lead_id")
    imprint = F.when((F.col("purpose") == "imprint") & imprint_hit(F.col("link"), F.col("title"), F.col("snippet"), F.col("own_domain")), F.col("position"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "title", "snippet").alias("t")))), lambda p: p["t"]), " ")  # the hits of one query
    per_query = answers.groupBy("lead_id", "purpose", "qno").agg(F.min_by("link", imprint).alias("imprint"), text.alias("text"))
    person = let(contacts.decision_maker(F.col("text"))["name"], lambda n: F.when(F.col("purpose") == "decision_maker", blank_to_null(sanitized("managing_director_name", n))))
    per_query = per_query.select("lead_id", "qno", F.coalesce("imprint", person).alias("found"))
    first = per_query.where("found IS NOT NULL").groupBy("lead_id").agg(F.min("qno").alias("good"), F.min_by("found", "qno").alias("found"))
    wanted = queue.select("lead_id", "ord", query_cap(clean_text("lead_quality")).alias("cap")).join(per_lead, "lead_id", "left").join(first, "lead_id", "left")
    wanted = wanted.withColumn("need", F.when(F.col("n_planned").isNotNull(), F.least("n_planned", "cap", "good")).otherwise(0))
    granted = query_budget(wanted, "need", budget).select("lead_id", "purpose", "granted", "queries", F.when(F.col("good") <= F.col("granted"), F.col("found")).alias("found"))
    used = granted.where("granted > 0")
    seen = hits.join(used.select("lead_id", "granted"), "lead_id").where("qno <= granted")
    told = summarize_hits(seen.withColumn("position", F.struct("qno", "position")), "lead_id").select("lead_id", F.col("summary").alias("_summary"), F.col("links").alias("_links"))
    rows = queue.join(used, "lead_id", "left").join(told, "lead_id", "left").withColumn("paid", F.coalesce("granted", F.lit(0)))
    ran, found = F.col("paid") > 0, F.coalesce("found", F.lit(""))
    imprint_found = ran & (F.col("purpose") == "imprint") & (found != "") & ~has("imprint_url")
    director = F.when(ran & (F.col("purpose") == "decision_maker"), overwritten("managing_director_name", F.col("managing_director_name"), found)).otherwise(clean_text("managing_director_name"))
    asked = F.array_join(F.transform(F.slice("queries", 1, F.greatest(F.col("paid").cast("int"), F.lit(1))), lambda q: q["query"]), " | ")
    rows = rows.withColumns({"_director": director, "_imprint": F.when(imprint_found, found).otherwise(clean_text("imprint_url"))})
    sure = F.when((F.col("purpose") == "imprint") & has("_imprint"), 0.75).when((F.col("purpose") == "decision_maker") & has("_director"), 0.70).otherwise(0.30)
    cells = {
        "imprint_url": F.col("_imprint"),
        "imprint_parse_status": F.when(imprint_found, "serper_url_found").otherwise(clean_text("imprint_parse_status")),
        "managing_director_source": F.when(has("_director") & (F.col("_director") != clean_text("managing_director_name")), "serper_snippet").otherwise(clean_text("managing_director_source")),
        "serper_used": F.when(ran, "true").otherwise(clean_text("serper_used")),
        "serper_queries": F.when(ran, asked).otherwise(clean_text("serper_queries")),
        "serper_result_urls": F.when(ran, F.coalesce("_links", F.lit(""))).otherwise(clean_text("serper_result_urls")),
        "serper_summary": F.when(ran, F.coalesce("_summary", F.lit(""))).otherwise(clean_text("serper_summary")),
        "serper_confidence_score": F.when(ran, two_places(sure)).otherwise(clean_text("serper_confidence_score")),
    }
    return rows.withColumns(cells).withColumn("managing_director_name", F.col("_director")).select(*queue.columns, "paid")


def known_url() -> Column:
    """The imprint's or else the contact page's address, if it is on the row's own domain."""
    own = lambda c: F.when(has(c) & ((_domain() == "") | (normalize_domain(c) == _domain())), clean_text(c))
    return F.coalesce(own("imprint_url"), own("contact_url"), F.lit(""))


def apply_scrapes(queue: DataFrame, scrapes: DataFrame, budget: int) -> DataFrame:
    """Scraped pages (lead_id, markdown, source_url, title, warning) onto the rows queued for scraping; ``paid`` is 1 for each page."""
    rows = queue.withColumns({"_url": known_url(), "_queued": queued_for("firecrawl")})
    rows = row_budget(rows, F.col("_queued") & has("_url"), budget)
    fresh = scrapes.select("lead_id", clean_text("markdown").alias("_markdown"), F.char_length("markdown").alias("_chars"), clean_text("source_url").alias("_source"), clean_text("title").alias("_title"), clean_text("warning").alias("_warning"))
    facts = with_identity(fresh, "_markdown", "_f_")
    rows = rows.join(facts.withColumn("_met", F.lit(True)), "lead_id", "left")
    ran, met = F.col("selected"), F.col("selected") & F.coalesce("_met", F.lit(False))
    fact = lambda c: F.coalesce(f"_f_{c}", F.lit(""))
    merge = lambda c: F.when(met, merged(c, F.col(c), fact(c))).otherwise(clean_text(c))
    found = points((has("imprint_url"), 20), ((fact("legal_name") != "") | (fact("legal_form") != ""), 20), (fact("managing_director_name") != "", 25), ((fact("general_email") != "") | (fact("phone_main") != ""), 15), (fact("address") != "", 10))
    confidence = F.when(F.col("_markdown") == "", 0.0).otherwise(F.least(F.when(has("imprint_url"), 97).otherwise(80), 20 + found) / 100.0)
    rows = rows.withColumn("_confidence", F.when(met, confidence))
    parsed = F.when(F.col("_confidence") >= 0.70, "complete").otherwise("low_confidence")
    source = F.coalesce(filled("_source"), F.col("_url"))
    pages = F.array_union(F.filter(F.split(clean_text("free_enrichment_source_urls"), r"\|"), lambda u: u != ""), F.array(source))
    summary = F.array_join(F.array_compact(F.array(filled("_title"), filled(F.substring("_markdown", 1, 280)), F.when(has("_warning"), F.concat(F.lit("Warning: "), F.substring("_warning", 1, 160))))), " | ")
    no_page = F.col("_queued") & ~has("_url")
    either = lambda yes, failed, c: F.when(met, yes).when(ran, failed).otherwise(clean_text(c))
    cells = {c: merge(c) for c in ("legal_name", "legal_form", "address", "general_email", "phone_main", "managing_director_name")}
    cells |= {
        "company_name": F.when(met & ~has("company_name") & (fact("legal_name") != ""), fact("legal_name")).otherwise(clean_text("company_name")),
        "managing_director_source": F.when(met & ~has("managing_director_source") & (fact("managing_director_name") != ""), "firecrawl_markdown").otherwise(clean_text("managing_director_source")),
        "firecrawl_used": F.when(ran, "true").otherwise(clean_text("firecrawl_used")),
        "firecrawl_source_url": either(source, F.col("_url"), "firecrawl_source_url"),
        "firecrawl_markdown_chars": F.when(met, F.coalesce(F.col("_chars"), F.lit(0)).cast("string")).otherwise(clean_text("firecrawl_markdown_chars")),
        "firecrawl_confidence_score": F.when(met, two_places(F.col("_confidence"))).otherwise(clean_text("firecrawl_confidence_score")),
        "firecrawl_summary": either(summary, F.lit("Firecrawl request failed; route to manual review."), F.when(no_page, "Skipped: no known same-domain imprint or contact URL.").otherwise(clean_text("firecrawl_summary"))),
        "firecrawl_error": either(F.lit(""), F.lit("no answer"), "firecrawl_error"),
        "confidence_score": F.when(met, two_places(F.greatest(F.coalesce(parse_confidence("confidence_score"), F.lit(0.0)), F.col("_confidence")))).otherwise(clean_text("confidence_score")),
        "imprint_parse_status": either(parsed, F.lit("failed"), "imprint_parse_status"),
        "free_enrichment_status": either(parsed, F.lit("failed"), "free_enrichment_status"),
        "free_enrichment_source_urls": F.when(met, F.array_join(pages, "|")).otherwise(clean_text("free_enrichment_source_urls")),
        "paid": F.when(ran, 1).otherwise(0),
    }
    return rows.select(*(cells[c].alias(c) if c in cells else F.col(c) for c in queue.columns), cells["paid"].alias("paid"))


def apply_research(queue: DataFrame, research: DataFrame, budget: float) -> DataFrame:
    """Research answers (lead_id, answer, hits, credits) onto the rows queued for research; ``paid`` is the credits used, one at least."""
    plan = plan_research()
    joined = F.concat_ws(" ", "answer", F.array_join(F.transform("hits", lambda h: F.concat_ws(" ", h["title"], h["content"], h["raw_content"])), " "))
    fresh = research.select("lead_id", clean_text("answer").alias("_answer"), F.col("hits").alias("_hits"), F.greatest(F.coalesce("credits", F.lit(1)), F.lit(1)).alias("_credits"), clean_text(joined).alias("_text"), F.lit(True).alias("_met"))
    who, company = contacts.decision_maker(F.col("_text")), contacts.company_identity(F.col("_text"))
    fresh = fresh.withColumns({"_person": who["name"], "_legal": company["legal_name"], "_form": company["legal_form"]})
    rows = queue.withColumns({"_query": plan["query"], "_purpose": plan["purpose"], "_queued": queued_for("tavily")}).join(fresh, "lead_id", "left")
    ready = F.col("_queued") & has("_query")
    rows = credit_budget(rows.withColumn("_cost", F.when(ready, F.coalesce("_credits", F.lit(1))).otherwise(0)), "_cost", budget)
    ran = ready & F.col("runs")
    met = ran & F.coalesce("_met", F.lit(False))
    links = F.array_distinct(F.filter(F.transform(F.coalesce("_hits", F.array()), lambda h: h["url"]), lambda u: u.isNotNull() & (u != "")))
    parts = F.transform(F.slice(F.coalesce("_hits", F.array()), 1, 3), lambda h: F.substring(clean_text(F.concat_ws(": ", h["title"], h["content"])), 1, 220))
    summary = F.array_join(F.filter(F.concat(F.array(F.substring("_answer", 1, 450)), parts), lambda p: p != ""), " | ")
    own = F.exists(links, lambda u: normalize_domain(u) == _domain())
    roles = F.lower("_text").rlike("geschäftsführer|geschaeftsfuehrer|inhaber")
    sure = F.when((F.size(links) == 0) & ~has("_answer"), 0.30).when(own & roles, 0.75).when(roles, 0.70).when(own, 0.65).otherwise(0.55)
    note = F.concat(F.lit("Tavily "), "_purpose", F.lit(" research"), F.when(has("_answer"), F.concat(F.lit(": "), F.substring("_answer", 1, 300))).otherwise(""), F.when(F.size(links) > 0, F.concat(F.lit(" Sources: "), F.array_join(F.slice(links, 1, 3), " | "))).otherwise(""))
    director = F.when(met & (F.coalesce("_person", F.lit("")) != ""), overwritten("managing_director_name", F.col("managing_director_name"), F.col("_person"))).otherwise(clean_text("managing_director_name"))
    rows = rows.withColumn("_director", director)
    either = lambda yes, failed, c: F.when(met, yes).when(ran, failed).otherwise(clean_text(c))
    cells = {
        "legal_name": F.when(met, merged("legal_name", F.col("legal_name"), F.col("_legal"))).otherwise(clean_text("legal_name")),
        "legal_form": F.when(met, merged("legal_form", F.col("legal_form"), F.col("_form"))).otherwise(clean_text("legal_form")),
        "company_name": F.when(met & ~has("company_name") & has("_legal"), F.col("_legal")).otherwise(clean_text("company_name")),
        "managing_director_name": F.col("_director"),
        "managing_director_source": F.when(has("_director") & (F.col("_director") != clean_text("managing_director_name")), "tavily_research").otherwise(clean_text("managing_director_source")),
        "tavily_used": F.when(ran, "true").otherwise(clean_text("tavily_used")),
        "tavily_queries": F.when(ran, F.col("_query")).otherwise(clean_text("tavily_queries")),
        "tavily_answer": F.when(met, F.col("_answer")).otherwise(clean_text("tavily_answer")),
        "tavily_result_urls": F.when(met, F.array_join(links, "|")).otherwise(clean_text("tavily_result_urls")),
        "tavily_summary": either(summary, F.lit("Tavily request failed; route to manual review."), F.when(F.col("_queued") & ~has("_query"), "Skipped: no useful research query could be planned.").otherwise(clean_text("tavily_summary"))),
        "tavily_confidence_score": F.when(met, two_places(sure)).otherwise(clean_text("tavily_confidence_score")),
        "tavily_credits": F.when(met, F.col("_credits").cast("string")).otherwise(clean_text("tavily_credits")),
        "tavily_error": either(F.lit(""), F.lit("no answer"), "tavily_error"),
        "research_note": F.when(met, note).otherwise(clean_text("research_note")),
    }
    return rows.select(*(cells[c].alias(c) if c in cells else F.col(c) for c in queue.columns), F.when(ran, F.col("_cost")).otherwise(0).alias("paid"))


_APPLY = {"serper": apply_search, "firecrawl": apply_scrapes, "tavily": apply_research}


def redecide(queue: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """Guarded columns are sanitized, flags written out, and eligibility and next step taken anew."""
    rows = queue.withColumns({c: sanitized(c, F.col(c)) for c in GUARDED})
    rows = decide(rows, enabled)
    return rows.withColumn("requires_external_provider", bool_string(has("provider_recommended")))


def run_waterfall(queue: DataFrame, answers: dict[str, DataFrame], limits: dict[str, int], enabled: dict[str, bool] | None = None, rounds: int = 2) -> tuple[DataFrame, list[dict]]:
    """Rounds over the providers until none has rows that are ready; returns the queue and a report of the steps.

    ``queue`` has lead_id, a distinct ``ord`` and the queue's columns (missing ones count as blank); ``answers`` has a table for
    each provider. Budgets are used up across rounds. Rows are never collected; each step is written to the shared folder.
    """
    enabled = dict.fromkeys(PROVIDERS, True) if enabled is None else enabled
    now = cut(redecide(conform(queue, QUEUE_COLUMNS), enabled), "waterfall")
    used, report = dict.fromkeys(PROVIDERS, 0), []
    for turn in range(1, rounds + 1):
        steps = []
        for p in PROVIDERS:
            if now.where(queued_for(p)).isEmpty():
                continue
            step = {"round": turn, "provider": p, "status": "skipped", "rows": 0, "spent": 0}
            left = limits.get(p, 0) - used[p]
            if enabled.get(p, False) and left > 0:
                served = cut(_APPLY[p](now, answers[p], left), f"waterfall-{p}")
                got = served.agg(F.count_if(F.col("paid") > 0).alias("n"), F.coalesce(F.sum("paid"), F.lit(0)).alias("spent")).first()
                used[p] += int(got.spent)
                step |= {"status": "completed", "rows": got.n, "spent": int(got.spent)}
                before, now = now, cut(redecide(served.drop("paid"), enabled), "waterfall")
                discard(before, served)
            steps.append(step)
        report += steps
        if not any(s["status"] == "completed" for s in steps):
            break
    return now, report
