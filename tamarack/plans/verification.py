"""Verification of lead sites from their fetched pages: one row of 43 columns for each lead.

All signals of a site come from one pass over its pages and one aggregation. Which terms of a dictionary a page holds is a bit mask, and a
site's mask is the OR of its pages', so a site of any number of pages has a state of fixed size. Only its paths, its claims and
its first address, number and id are gathered besides. A term that runs over the end of a page is not found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, markers
from ..functions.values import clean_text, is_dach, normalize_domain, yes_no
from ..operators import classify
from ..operators.pages import html_text
from .gates import Cells

# The columns of a verification row, in order.
VERIFIED_COLUMNS = ["domain", "source_url", "company_name", "scoring_mode", "lead_type", "is_shop", "is_woocommerce", "detected_platform", "detected_platform_signals", "niche", "care_lead_type", "ik_number", "care_product_signals", "care_gkv_signals", "care_process_signals", "care_insurer_signals", "care_ratgeber_signals", "care_disqualifier_signals", "scale_indicators", "is_dach", "vhd_fit_score", "next_action", "exclusion_reason", "email", "phone", "reachable_pages", "checked_pages", "best_status", "avg_response_ms", "total_html_kb", "http_request_count", "robots_status", "skipped_by_robots", "policy_skip_reason", "verified_signals", "shop_signals", "woocommerce_signals", "tracking_signals", "legal_trust_signals", "possible_shop_levers", "input_lead_score", "input_signals", "checked_at"]
#: Dictionaries by what of a page they are looked for in; each can be replaced by name.
DICTIONARIES = {
    "shop": ("both", markers.SHOP_TERMS), "product": ("html", markers.PRODUCT), "shipping": ("text", markers.SHIPPING_PAYMENT), "legal": ("text", markers.LEGAL_TRUST), "strong": ("both", markers.STRONG_COMMERCE),
    **{f"care_{k}": ("both", terms) for k, terms in markers.CARE.items()},
}
_WIDTH = 60


def masks(text: Column, terms: list[str]) -> list[Column]:
    """Which of the terms a text holds, as bits of one long for each ``_WIDTH`` terms."""
    out = []
    for a in range(0, len(terms), _WIDTH):
        bits = [F.when(text.contains(t), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(terms[a : a + _WIDTH])]
        out.append(reduce(lambda x, y: x.bitwiseOR(y), bits))
    return out


def terms_of(columns: list[str], terms: list[str]) -> Column:
    """The terms whose bits are set, in the terms' order."""
    parts = [F.when(F.col(columns[i // _WIDTH]).bitwiseAND(F.lit(1 << i % _WIDTH)) != 0, F.lit(t)) for i, t in enumerate(terms)]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def _edges(pages: DataFrame, head: int, tail: int) -> DataFrame:
    """``pages`` that hold some of the first ``head`` or last ``tail`` characters of their site's text, with these as ``window``."""
    sizes = pages.select("domain", "fetch_order", (F.char_length("text") + 1).alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY domain ORDER BY fetch_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    behind = F.expr("coalesce(sum(n) OVER (PARTITION BY domain ORDER BY fetch_order DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    near = sizes.withColumns({"before": before, "behind": behind}).where(f"before < {head} OR behind < {tail}").select("domain", "fetch_order", "before", "behind")
    rest = F.greatest(F.lit(0), F.least(F.char_length("text"), tail - F.col("behind"))).cast("int")
    start = F.when(F.col("before") < head, F.substring("text", F.lit(1), (head - F.col("before")).cast("int"))).otherwise("")
    end = F.when(rest > 0, F.expr("right(text, rest)")).otherwise("")
    return pages.select("domain", "fetch_order", "text").join(near, ["domain", "fetch_order"]).withColumn("rest", rest).select("domain", F.concat_ws("\n", start, end).alias("window"))


def site_signals(pages: DataFrame, dictionaries: dict | None = None, platforms: dict | None = None, tracking: dict | None = None, claims: list[str] = contacts.SCALE_CLAIMS, labelled: str | None = contacts.ID_LABELLED, business: bool = False) -> DataFrame:
    """For each domain of fetched pages (domain, path, url, status, elapsed_ms, html, fetch_order): hits, contacts and figures.

    ``business`` adds the hits of the business terms in the first 8000 and last 2000 characters of the site's text. Empty dictionaries,
    no claims and no pattern of an id leave these out. Pages that have a ``text`` aren't stripped again.
    """
    known = DICTIONARIES if dictionaries is None else dictionaries
    platforms, tracking = markers.PLATFORMS if platforms is None else platforms, markers.TRACKING if tracking is None else tracking
    p = pages.withColumn("html", F.coalesce("html", F.lit("")))
    p = p if "text" in p.columns else p.withColumn("text", html_text("html"))
    p = p.withColumns({"_text": F.lower("text"), "_html": F.lower("html")}).withColumn("_both", F.concat_ws(" ", "_text", "_html"))
    families = {name: (where, sorted(set(terms))) for name, (where, terms) in known.items()}
    families |= {f"platform_{i}": ("html", terms) for i, terms in enumerate(platforms.values())} | {f"tracking_{i}": ("html", terms) for i, (_, terms) in enumerate(sorted(tracking.items()))}
    of = {}
    for name, (where, terms) in families.items():
        for j, mask in enumerate(masks(F.col(f"_{where}"), [t.lower() for t in terms])):
            of.setdefault(name, []).append(f"{name}_{j}")
            p = p.withColumn(f"{name}_{j}", mask)
    none = F.array().cast("array<struct<which:int,said:string>>")
    found = F.filter(F.concat(none, *(F.transform(F.regexp_extract_all(F.col("text"), F.lit(c), F.lit(0)), _claim(i)) for i, c in enumerate(claims))), lambda x: x["said"] != "")
    own_id = contacts.registration_id(F.concat_ws(" ", "text", "html"), labelled) if labelled else F.lit("")
    p = p.withColumns({"_email": contacts.site_email("text"), "_phone": contacts.site_phone("text"), "_id": own_id, "_claims": found})
    ok = F.col("status").between(200, 399) & (F.col("html") != "")
    one = F.struct("fetch_order", "path", "status")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("fetch_order"))), F.lit("")).alias(c)
    site = p.groupBy("domain").agg(
        *(F.bit_or(c).alias(c) for columns in of.values() for c in columns),
        first("_email"), first("_phone"), first("_id"),
        F.array_sort(F.collect_list(F.when(F.size("_claims") > 0, F.struct("fetch_order", "_claims")))).alias("_claims"),
        F.array_sort(F.collect_list(one)).alias("_every"), F.array_sort(F.collect_list(F.when(ok, one))).alias("_good"), F.count("*").alias("requests"),
        F.coalesce(F.floor(F.avg(F.when(F.col("status") != 0, F.col("elapsed_ms")))).cast("int"), F.lit(0)).alias("avg_response_ms"),
        F.floor(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / 1024).cast("long").alias("total_html_kb"),
        F.coalesce(F.min(F.when(F.col("status") != 0, F.col("status"))), F.lit(0)).alias("best_status"),
    )
    said = F.array_sort(F.flatten(F.transform("_claims", lambda c: F.transform(c["_claims"], lambda x, i: F.struct(x["which"].alias("a"), c["fetch_order"].alias("b"), i.alias("c"), x["said"].alias("said"))))))
    label = F.coalesce(*(F.when(reduce(lambda x, y: x | y, [F.col(c) != 0 for c in of[f"platform_{i}"]]), F.lit(n)) for i, n in enumerate(platforms)), F.lit(""))
    shown = F.coalesce(*(F.when(F.size(terms_of(of[f"platform_{i}"], t)) > 0, terms_of(of[f"platform_{i}"], t)) for i, t in enumerate(platforms.values())), F.array().cast("array<string>"))
    at = list(platforms).index(markers.TARGET_PLATFORM) if markers.TARGET_PLATFORM in platforms else None
    target = F.array().cast("array<string>") if at is None else terms_of(of[f"platform_{at}"], platforms[markers.TARGET_PLATFORM])
    tools = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(of[f"tracking_{i}"][0]) != 0, F.lit(n)) for i, n in enumerate(sorted(tracking)))))
    out = site.select(
        "domain", F.col("_email").alias("email"), F.col("_phone").alias("phone"), F.col("_id").alias("ik_number"), "requests", "avg_response_ms", "total_html_kb", "best_status",
        *(terms_of(of[n], families[n][1]).alias(n) for n in known), label.alias("platform"), shown.alias("platform_signals"), target.alias("target"), tools.alias("tracking"),
        F.array_distinct(F.transform(said, lambda x: x["said"])).alias("claims"), F.transform("_good", lambda x: x["path"]).alias("reachable"), F.transform("_every", lambda x: F.concat_ws(":", x["path"], x["status"])).alias("checked"),
    )
    if business:
        edges = _edges(p.select("domain", "fetch_order", F.col("_text").alias("text")), 8000, 2000)
        kinds = {k: sorted(set(terms)) for k, terms in markers.BUSINESS_TERMS.items()}
        hits = {f"{k}_{j}": m for k, terms in kinds.items() for j, m in enumerate(masks(F.col("window"), terms))}
        edges = edges.withColumns(hits).groupBy("domain").agg(*(F.bit_or(c).alias(c) for c in hits))
        windows = [F.array_join(terms_of([c for c in hits if c.rsplit("_", 1)[0] == k], terms), "\n") for k, terms in kinds.items()]
        out = out.join(edges.select("domain", F.concat_ws("\n", *windows).alias("window")), "domain", "left")
    return out


def _claim(which: int):
    return lambda m: F.struct(F.lit(which).alias("which"), clean_text(m).alias("said"))


def verify(leads: DataFrame, pages: DataFrame, now: str, niche: str = "pflegebox", mode: str = "standard", cooldown: DataFrame | None = None, **parameters) -> DataFrame:
    """``leads`` (domain or source_url or url, and whatever else they state) to VERIFIED_COLUMNS, one for one.

    Leads without a domain, with one in ``cooldown`` (domain), and with one that is never a lead are skipped or rejected before their pages
    count. What a lead row states of address and number stays. ``parameters`` go to ``site_signals``.
    """
    c = Cells(leads.columns)
    site = normalize_domain(c.first("domain", "source_url", "url"))
    rows = leads.select(
        site.alias("domain"), c.first("source_url", "url", "domain").alias("source_url"), c["company_name"].alias("company_name"), c["email"].alias("own_email"), c["phone"].alias("own_phone"), F.upper(c["country_hint"]).alias("country"),
        c.first("lead_score", "input_lead_score").alias("input_lead_score"), c.first("signals", "input_signals").alias("input_signals"),
    )
    waits = F.lit(False)
    if cooldown is not None:
        rows = rows.join(cooldown.select(normalize_domain("domain").alias("domain"), F.lit(True).alias("_waits")).distinct(), "domain", "left")
        waits = F.coalesce("_waits", F.lit(False))
    blocked = markers.blocked_reason("domain")
    rows = rows.withColumn("stopped", F.when(F.col("domain") == "", "missing_domain").when(waits, "domain_cooldown").otherwise(blocked))
    care = niche == "pflegebox"
    parameters["dictionaries"] = DICTIONARIES | (parameters.get("dictionaries") or {})
    signals = site_signals(pages, business=not care, **parameters)
    r = rows.join(signals.withColumnRenamed("domain", "_site"), (F.col("stopped") == "") & (F.col("domain") == F.col("_site")), "left")
    text = lambda name: F.coalesce(name, F.lit(""))
    hits = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    n = lambda name: F.size(hits(name))
    r = r.withColumns({"_email": F.when(F.col("own_email") != "", F.col("own_email")).otherwise(text("email")), "_phone": F.when(F.col("own_phone") != "", F.col("own_phone")).otherwise(text("phone"))})
    carts = F.array_intersect(hits("reachable"), F.array(*map(F.lit, classify.CART_PATHS)))
    woo = F.array_sort(hits("target"))
    flags = classify.shop_flags(n("reachable") > 0, hits("strong"), F.size(woo), n("product"), hits("shop"), F.size(carts) > 0, n("shipping"), n("legal"))
    dach = F.col("country").isin("DE", "AT", "CH") | is_dach("domain")
    r = r.withColumns({**flags, "_dach": dach, "_woo": woo, "_carts": carts, "_ms": F.coalesce("avg_response_ms", F.lit(0)), "_kb": F.coalesce("total_html_kb", F.lit(0))})
    registered = text("ik_number") != ""
    has = lambda name: F.col(name) != ""
    if care:
        kind = classify.classify_site_care(n("care_product"), n("care_gkv"), n("care_process"), n("care_ratgeber"), n("care_disqualifier"), registered)
        score = classify.fit_score_care(F.col("_kind.lead_type"), registered, n("care_product"), n("care_gkv"), n("care_process"), n("care_insurers"), n("claims"), F.col("_dach"), has("_email"), has("_phone"))
        action = classify.next_action_care(F.col("_kind.lead_type"), F.col("_score"), registered)
    else:
        kind = classify.classify_site(F.col("domain"), F.lower(F.concat_ws("\n", "domain", "window")), text("platform"), F.col("is_shop"), F.col("confirmed_shop"))
        score = classify.fit_score(F.col("_kind.lead_type"), F.col("is_shop"), F.col("is_woocommerce"), F.col("_dach"), has("_email"), has("_phone"), n("product") > 0, n("shipping") > 0, n("tracking") > 0, n("legal") > 0, F.col("_ms"))
        action = classify.next_action(F.col("_kind.lead_type"), F.col("_score"), F.col("is_woocommerce"))
    r = r.withColumn("_kind", kind).withColumn("_score", score).withColumn("_action", action)
    levers = classify.levers(F.col("is_shop"), F.col("is_woocommerce"), n("product") > 0, hits("tracking"), n("shipping") > 0, n("legal") > 0, F.col("_ms"), F.col("_kb"))
    verified = F.array_compact(F.array(*(F.when(cond, word) for cond, word in ((F.col("is_shop"), "shop"), (F.col("is_woocommerce"), "woocommerce"), (F.col("_dach"), "dach"), (has("_email"), "email"), (has("_phone"), "phone")))))
    joined = lambda name: F.array_join(hits(name), "|")
    shop = F.array_sort(F.array_distinct(F.concat(hits("shop"), hits("strong"), F.col("_carts"))))
    cells = {
        "scoring_mode": F.lit(mode), "lead_type": F.col("_kind.lead_type"), "is_shop": yes_no(F.col("is_shop")), "is_woocommerce": yes_no(F.col("is_woocommerce")), "detected_platform": text("platform"), "detected_platform_signals": joined("platform_signals"),
        "niche": F.lit(niche), "care_lead_type": F.col("_kind.lead_type") if care else F.lit(""), "ik_number": text("ik_number"), "scale_indicators": joined("claims"), "is_dach": yes_no(F.col("_dach")), "vhd_fit_score": F.col("_score").cast("string"),
        "care_product_signals": joined("care_product"), "care_gkv_signals": joined("care_gkv"), "care_process_signals": joined("care_process"), "care_insurer_signals": joined("care_insurers"), "care_ratgeber_signals": joined("care_ratgeber"), "care_disqualifier_signals": joined("care_disqualifier"),
        "next_action": F.col("_action"), "exclusion_reason": F.col("_kind.exclusion_reason"), "email": F.col("_email"), "phone": F.col("_phone"), "reachable_pages": joined("reachable"), "checked_pages": joined("checked"), "best_status": F.coalesce("best_status", F.lit(0)).cast("string"),
        "avg_response_ms": F.col("_ms").cast("string"), "total_html_kb": F.col("_kb").cast("string"), "http_request_count": F.coalesce("requests", F.lit(0)).cast("string"), "robots_status": F.lit(""), "skipped_by_robots": F.lit("no"), "policy_skip_reason": F.lit(""),
        "verified_signals": F.array_join(verified, "|"), "shop_signals": F.array_join(shop, "|"), "woocommerce_signals": F.array_join("_woo", "|"), "tracking_signals": joined("tracking"), "legal_trust_signals": joined("legal"), "possible_shop_levers": F.array_join(levers, "|"),
    }
    never = F.col("stopped").startswith("missing") | (F.col("stopped") == "domain_cooldown")
    halted = {"scoring_mode": F.lit(mode), "lead_type": F.when(never, "skipped").otherwise("rejected"), "is_shop": F.lit("no"), "is_woocommerce": F.lit("no"), "is_dach": yes_no(is_dach("domain")), "vhd_fit_score": F.lit("0"), "next_action": F.when(never, "skip").otherwise("reject"), "exclusion_reason": F.col("stopped"), "policy_skip_reason": F.col("stopped")}
    always = {"domain": F.col("domain"), "source_url": F.col("source_url"), "company_name": F.col("company_name"), "input_lead_score": F.col("input_lead_score"), "input_signals": F.col("input_signals"), "checked_at": F.lit(now)}
    return r.select(*((always[k] if k in always else F.when(F.col("stopped") != "", halted.get(k, F.lit(""))).otherwise(cells[k])).alias(k) for k in VERIFIED_COLUMNS))
