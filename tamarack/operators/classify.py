"""Classification, scores and grades: CASE expressions over a site's gathered signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import markers
from ..functions.values import as_col, clean_text, first_filled, has, let, normalize_category, parse_score, split_tokens, truthy


def points(*terms: tuple[Column, int]) -> Column:
    """Sum of the points of the conditions that hold."""
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in terms])


def capped(count: Column | str, each: int, most: int) -> Column:
    return F.least(F.lit(most), as_col(count) * each)


def identity_window(domain: Column, text: Column) -> Column:
    """The domain with the first 8000 and last 2000 characters of a text, in lower case."""
    tail = F.when(F.char_length(text) > 2000, F.substring(text, -2000, 2000)).otherwise(text)
    return F.lower(F.concat_ws(" ", domain, F.substring(text, 1, 8000), tail))


# Commerce markers that confirm a shop, and the words of a cart page.
SURE_COMMERCE = ["add-to-cart", "single_add_to_cart_button", "wc-cart", "woocommerce-cart", "woocommerce-checkout"]
CART_WORDS = ["warenkorb", "kasse"]
CART_PATHS = ["/warenkorb", "/kasse", "/checkout", "/cart"]


def shop_flags(reachable: Column, strong: Column, platform_n: Column, product_n: Column, shop: Column, cart_reached: Column, shipping_n: Column, legal_n: Column) -> dict[str, Column]:
    """is_woocommerce, is_shop and confirmed_shop of a site; ``strong`` and ``shop`` are arrays of hits, the others counts or flags."""
    cart_words = F.arrays_overlap(shop, F.array(*map(F.lit, CART_WORDS)))
    is_shop = reachable & ((F.size(strong) > 0) | (product_n > 0) | cart_reached | ((shipping_n > 0) & (legal_n > 0) & cart_words))
    target = platform_n > 0
    sure = cart_reached | F.arrays_overlap(strong, F.array(*map(F.lit, SURE_COMMERCE)))
    return {"is_woocommerce": target, "is_shop": is_shop, "confirmed_shop": is_shop & target & sure}


def classify_site(domain: Column, window: Column, platform: Column, is_shop: Column, confirmed: Column) -> Column:
    """struct(lead_type, exclusion_reason) of a shop site."""
    out = lambda kind, reason: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("lead_type"), (F.lit(reason) if isinstance(reason, str) else reason).alias("exclusion_reason"))
    blocked = markers.blocked_reason(domain)
    agencies = F.size(markers.matching_terms(window, markers.BUSINESS_TERMS["agency"]))
    result = (
        F.when((platform != "") & (platform != markers.TARGET_PLATFORM), out("non_target_platform", F.concat(F.lit("platform_"), platform)))
        .when(blocked != "", out("rejected", blocked))
        .when(confirmed & (agencies >= 2), out("review", "shop_or_agency_mixed"))
        .when(confirmed, out("shop", ""))
    )
    for kind, terms in markers.BUSINESS_TERMS.items():
        met = markers.any_term(window, terms)
        result = result.when(met & is_shop, out("review", f"shop_or_{kind}_mixed")).when(met, out(*markers.BUSINESS_RESULTS[kind]))
    return result.when(is_shop, out("shop", "")).otherwise(out("unknown", "not_enough_shop_signals"))


def classify_site_care(product: Column, gkv: Column, process: Column, ratgeber: Column, disqualifier: Column, registered: Column) -> Column:
    """struct(lead_type, exclusion_reason) of a care site, from its numbers of hits."""
    out = lambda kind, reason: F.struct(F.lit(kind).alias("lead_type"), F.lit(reason).alias("exclusion_reason"))
    return (
        F.when(disqualifier >= 2, out("service_provider", "out_of_icp_business_type"))
        .when((ratgeber >= 3) & (process == 0) & ~registered, out("ratgeber_site", "ratgeber_or_content_site"))
        .when(registered & ((product >= 1) | (process >= 1)), out("pflegebox_anbieter", ""))
        .when((product >= 2) & (gkv >= 2) & (process >= 1), out("pflegebox_anbieter", ""))
        .when((product >= 1) | (process >= 1), out("review", "weak_care_signals"))
        .otherwise(out("rejected", "no_care_signals"))
    )


# Care lead types that are out.
CARE_OUT = ["rejected", "ratgeber_site", "service_provider"]


def fit_score(lead_type: Column, is_shop: Column, is_woocommerce: Column, dach: Column, email: Column, phone: Column, product: Column, shipping: Column, tracking: Column, legal: Column, ms: Column) -> Column:
    """0 to 100 for a shop site; at most 25 for what is no shop and 55 under review."""
    score = points((is_shop, 30), (is_woocommerce, 25), (dach, 10), (email, 8), (phone, 5), (product, 8), (shipping, 7), (tracking, 5), (legal, 4), (ms >= 1200, 3))
    return F.when(lead_type == "review", F.least(score, F.lit(55))).when(lead_type != "shop", F.least(score, F.lit(25))).otherwise(F.least(score, F.lit(100)))


def fit_score_care(lead_type: Column, registered: Column, product: Column, gkv: Column, process: Column, insurers: Column, claims: Column, dach: Column, email: Column, phone: Column) -> Column:
    """0 to 100 for a care site; 0 for what is out and at most 55 under review."""
    hits = capped(product, 5, 15) + capped(gkv, 3, 15) + capped(process, 5, 10) + capped(insurers, 2, 10) + capped(claims, 4, 10)
    score = hits + points((registered, 35), (dach, 5), (email, 4), (phone, 3))
    return F.when(lead_type.isin(CARE_OUT), 0).when(lead_type == "review", F.least(score, F.lit(55))).otherwise(F.least(score, F.lit(100)))


def levers(is_shop: Column, is_woocommerce: Column, product: Column, tracking: Column, shipping: Column, legal: Column, ms: Column, kb: Column) -> Column:
    """Ordered distinct levers by which a shop could grow; ``tracking`` is the array of its tracking tools."""
    tool = lambda name: F.array_contains(tracking, name)
    some = F.size(tracking) > 0
    heat = some & tool("gtm") & ~tool("microsoft_clarity")
    tags = some & tool("ga4") & ~tool("gtm")
    mail = some & (tool("klaviyo") | tool("mailchimp"))
    steps = [
        F.when(is_woocommerce, "woocommerce_growth_system").otherwise("platform_check_needed"),
        F.when(some, "tracking_stack_visible").otherwise("tracking_gap_possible"),
        F.when(heat, "tracking_check"),
        F.when(heat, "clarity_heatmap_opportunity"),
        F.when(tags, "tracking_check"),
        F.when(tags, "gtm_setup_check"),
        F.when(mail, "advanced_email_marketing_stack"),
        F.when(mail, "reputation_first_approach"),
        F.when(~product, "product_data_schema_check"),
        F.when(shipping, "checkout_payment_shipping_review").otherwise("checkout_shipping_info_check"),
        F.when(~legal, "trust_legal_surface_check"),
        F.when((ms >= 1200) | (kb >= 900), "performance_check"),
        F.lit("conversion_path_review"),
    ]
    return F.when(is_shop, F.array_distinct(F.array_compact(F.array(*steps)))).otherwise(F.array().cast("array<string>"))


def next_action(lead_type: Column, score: Column, is_woocommerce: Column) -> Column:
    return (
        F.when(lead_type.isin("review", "unknown"), "manual_review")
        .when(lead_type != "shop", "reject")
        .when(score >= 70, "loom_candidate")
        .when(score >= 50, "manual_review_high")
        .when(is_woocommerce, "manual_review_woocommerce")
        .otherwise("manual_review_low")
    )


def next_action_care(lead_type: Column, score: Column, registered: Column) -> Column:
    return (
        F.when(lead_type.isin(CARE_OUT), "reject")
        .when(lead_type == "review", "manual_review")
        .when((score >= 85) & registered, "loom_candidate")
        .when(score >= 65, "manual_review_high")
        .when(registered, "manual_review_ik_verified")
        .otherwise("manual_review_no_ik")
    )


# Lead types that go on to manual review.
REVIEW_TYPES = ["review", "unknown"]


def bucket(lead_type: Column, score: Column, action: Column, min_score: int = 50) -> Column:
    """verified, review or rejected; null for a row that was skipped."""
    return (
        F.when(lead_type == "skipped", None)
        .when(lead_type.isin("shop", "pflegebox_anbieter") & (score >= min_score), "verified")
        .when(lead_type.isin("shop", "pflegebox_anbieter", *REVIEW_TYPES) & (action != "reject"), "review")
        .otherwise("rejected")
    )


# Lead types and reasons that grade as rejected.
SHOP_OUT = ["service_provider", "agency", "platform_provider", "publisher", "fulfillment_provider", "payment_provider", "non_target_platform"]
CARE_REASONS_OUT = ["no_care_signals", "ratgeber_or_content_site", "out_of_icp_business_type"]


def grade_care(lead_type: Column, score: Column, reason: Column) -> Column:
    return (
        F.when(lead_type.isin(CARE_OUT) | reason.isin(CARE_REASONS_OUT), "Reject")
        .when(lead_type == "pflegebox_anbieter", F.when(score >= 75, "A++").when(score >= 60, "A+").when(score >= 45, "A").when(score >= 30, "B").otherwise("Review"))
        .when(lead_type == "review", "Review")
        .when(score >= 60, "A")
        .when(score >= 45, "B")
        .when(score >= 30, "Review")
        .otherwise("C")
    )


def grade_shop(lead_type: Column, score: Column, reason: Column, platform: Column, is_shop: Column, is_woocommerce: Column, has_lever: Column) -> Column:
    return (
        F.when((platform != "") & (platform != markers.TARGET_PLATFORM), "Reject")
        .when((reason != "") | lead_type.isin(SHOP_OUT), "Reject")
        .when(is_woocommerce & (score >= 85) & has_lever, "A++")
        .when(is_woocommerce & (score >= 70), "A+")
        .when(is_shop & (score >= 60), "A")
        .when(is_shop & (score >= 45), "B")
        .when((lead_type == "review") | (score >= 35), "Review")
        .otherwise("C")
    )


def grade(row: dict[str, Column]) -> Column:
    """Grade of a verification row given as cleaned text columns: by category, else by the niche's rules."""
    get = lambda *names: first_filled(*(row[n] for n in names if n in row)) if any(n in row for n in names) else F.lit("")
    score = parse_score(get("vhd_fit_score", "score", "verification_score"))
    reason = get("exclusion_reason", "error_reason")
    care = grade_care(F.lower(get("care_lead_type", "lead_type")), score, F.lower(reason))
    shop = grade_shop(F.lower(get("lead_type")), score, reason, F.lower(get("detected_platform")), truthy(get("is_shop")), truthy(get("is_woocommerce", "woocommerce_detected")), get("possible_shop_levers") != "")
    category = get("category")
    return F.when(category != "", normalize_category(category)).when(F.lower(get("niche")) == "pflegebox", care).otherwise(shop)


# --- scores of leads -----------------------------------------------------------------------------

# Levers by what they hurt, and those that count as strong.
TECHNICAL_LEVERS = ["tracking_gap_possible", "tracking_check", "clarity_heatmap_opportunity", "gtm_setup_check", "performance_check", "product_data_schema_check", "woocommerce_growth_system", "advanced_email_marketing_stack"]
CONVERSION_LEVERS = ["checkout_payment_shipping_review", "conversion_path_review", "cart_checkout", "checkout", "shipping", "payment"]
STRONG_LEVERS = ["woocommerce_growth_system", "checkout_payment_shipping_review", "conversion_path_review", "tracking_gap_possible", "clarity_heatmap_opportunity", "performance_check"]
LEAD_TYPES_OUT = ["service_provider", "agency", "platform", "publisher"]


def _text(name: str, columns: list[str]) -> Column:
    return clean_text(name) if name in columns else F.lit("")


def base_fit_score(columns: list[str]) -> Column:
    return F.greatest(*(parse_score(_text(n, columns)) for n in ("vhd_fit_score", "lead_score", "input_lead_score")))


def pain_scores(columns: list[str]) -> dict[str, Column]:
    """Relevance, technical, conversion, potential and overall scores of a lead row, and its priority."""
    fit = base_fit_score(columns)
    tokens = split_tokens(_text("possible_shop_levers", columns), lower=True)
    signals = F.array_union(split_tokens(_text("signals", columns), lower=True), split_tokens(_text("input_signals", columns), lower=True))
    known = lambda names: F.size(F.array_intersect(tokens, F.array(*map(F.lit, names))))
    flag_shop, flag_target = truthy(_text("is_shop", columns)), truthy(_text("is_woocommerce", columns))
    shop = flag_shop | F.array_contains(signals, "cart_checkout") | F.array_contains(signals, "active_shop")
    target = flag_target | F.array_contains(signals, "woocommerce")
    dach = truthy(_text("is_dach", columns)) | F.upper(_text("country_hint", columns)).isin("DE", "AT", "CH")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    relevance = clamp(fit + points((shop, 15), (target, 15), (dach, 5)))
    technical = clamp(F.least(F.lit(100), 20 + 12 * known(TECHNICAL_LEVERS)) + points((target, 12)))
    conversion = clamp(F.least(F.lit(100), 15 + 15 * known(CONVERSION_LEVERS)) + points((F.array_contains(tokens, "checkout_payment_shipping_review"), 15)))
    potential = clamp(fit + points((F.array_contains(tokens, "advanced_email_marketing_stack"), 12), (target & shop, 10)))
    overall = clamp(F.rint(relevance * F.lit(0.35) + technical * F.lit(0.25) + conversion * F.lit(0.20) + potential * F.lit(0.20)).cast("int"))
    out = (has(_text("exclusion_reason", columns))) | F.lower(_text("lead_type", columns)).isin(LEAD_TYPES_OUT)
    grades = lambda n: F.when(~flag_shop & ~flag_target, F.when(n >= 45, "Review").otherwise("Reject")).when(n >= 75, "A").when(n >= 55, "B").when(n >= 40, "C").otherwise("Review")
    priority = F.when(out, "Reject").otherwise(let(overall, grades))
    return {"shop_relevance_score": relevance, "technical_pain_score": technical, "conversion_pain_score": conversion, "business_potential_score": potential, "overall_numeric_score": overall, "overall_priority": priority}


def lead_quality(columns: list[str]) -> Column:
    """A++, A+, A, B or C."""
    score, kind = base_fit_score(columns), F.lower(_text("lead_type", columns))
    shop, target = truthy(_text("is_shop", columns)), truthy(_text("is_woocommerce", columns))
    strong = F.arrays_overlap(split_tokens(_text("possible_shop_levers", columns), lower=True), F.array(*map(F.lit, STRONG_LEVERS)))
    return (
        F.when(has(_text("exclusion_reason", columns)) | kind.isin(*LEAD_TYPES_OUT, "rejected"), "C")
        .when(target & shop & (score >= 85) & strong, "A++")
        .when(target & (score >= 70), "A+")
        .when(shop & (score >= 60), "A")
        .when(kind.isin(REVIEW_TYPES) | (score >= 40), "B")
        .otherwise("C")
    )


# What to say for each lever, in order.
ANGLES = [
    (["checkout_payment_shipping_review"], "Checkout-, Zahlungs- und Versandstrecke pruefen; konkrete Reibungspunkte fuer WooCommerce-Wachstum vermuten."),
    (["tracking_gap_possible", "clarity_heatmap_opportunity"], "Tracking- und Heatmap-Setup pruefen; bessere Entscheidungsgrundlage fuer Shop-Optimierung schaffen."),
    (["gtm_setup_check"], "Tag-Manager-Setup strukturieren und Tracking sauberer steuerbar machen."),
    (["product_data_schema_check"], "Produktdaten und strukturierte Daten als Conversion- und SEO-Hebel pruefen."),
    (["performance_check"], "Performance- und Ladezeithebel fuer Shop und Checkout priorisieren."),
    (["woocommerce_growth_system"], "WooCommerce-Wachstumssystem mit technischem Conversion-Fokus pruefen."),
]
ANGLE_ELSE = "Shop-Relevanz manuell pruefen und konkreten WooCommerce-Hebel schaerfen."


def outreach_angle(lever_tokens: Column) -> Column:

    def body(tokens: Column) -> Column:
        result = None
        for names, text in ANGLES:
            met = F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
            result = F.when(met, text) if result is None else result.when(met, text)
        return result.otherwise(ANGLE_ELSE)

    return let(lever_tokens, body)


def desired_role(priority: Column, is_woocommerce: Column) -> Column:
    return F.when(priority.isin("A", "B") | is_woocommerce, "Inhaber/Geschaeftsfuehrer oder E-Commerce-Leitung").otherwise("Inhaber/Geschaeftsfuehrer")


def technology_stack(is_woocommerce: Column, signal_tokens: Column, tracking_tokens: Column) -> Column:
    first = F.array_compact(F.array(F.when(is_woocommerce, "woocommerce"), F.when(F.array_join(signal_tokens, " ").contains("wordpress"), "wordpress")))
    return F.array_join(F.array_distinct(F.concat(first, tracking_tokens)), "|")
