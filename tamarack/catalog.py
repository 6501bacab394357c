"""The registered queries of the engine, each over its whole table, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import contacts, markers
from .functions.values import clamp_score, clean_text, country_hint, is_dach, lead_id, merge_tokens, normalize_category, normalize_domain, normalize_url, parse_confidence, parse_score, split_tokens
from .operators import budget, classify, dictionary, facts, merge, pages, search
from .plans import gates, patches, queue, runs
from .plans import single_pass as single_passes
from .plans import verification as verifications
from .plans import waterfall as waterfalls
from .sources.tables import read_master, shared_folder, spread, table

FLAGSHIP = "site_grades"

# --- pieces of SQL -------------------------------------------------------------------------------

HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^.*?://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '^\.+|\.+$', '', 'g'), '^www\.', '')"
TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script.*?>.*?</script>', ' ', 'gis'), '<style.*?>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '[\s\p{Z}]+', ' ', 'g'))"
SITES = f"""p AS (
  SELECT page_id, url, html, {HOST} AS domain, {TEXT} AS text, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS fetch_order,
    '/' || split_part(regexp_replace(url, '^.*?://[^/]*/', ''), '/', 1) AS path,
    CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 0 ELSE 200 END AS status, 100 + (page_id * 37) % 2500 AS elapsed_ms
  FROM pages)"""

#: Words that the test pages hold, in the families of the care niche: dictionaries are parameters.
WORDS = {"product": ["thing", "keit", "eaux", "ción"], "gkv": ["with", "sich", "pour", "una "], "process": ["edthan", "vererbe", "treaux", "ciónes"], "insurers": ["anhe", "schen", "elle", "mente"], "ratgeber": ["wiki", "thereat", "geund", "levi la"], "disqualifier": ["reonthe", "enzuer", "ouoi", "llasci"]}


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as fetched pages: path, status and elapsed_ms follow from the page's key."""
    p = pages.read_pages(table(spark, sf, "pages"))
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 29 == 0, 0).otherwise(200)
    path = F.concat(F.lit("/"), F.split_part(F.regexp_replace("url", r"^.*?://[^/]*/", ""), F.lit("/"), F.lit(1)))
    order = F.expr("row_number() OVER (PARTITION BY domain ORDER BY page_id)")
    return p.withColumns({"text": pages.html_text("html"), "path": path, "status": status, "elapsed_ms": 100 + (F.col("page_id") * 37) % 2500, "fetch_order": order})


# --- pages ---------------------------------------------------------------------------------------


def pages_normalized(spark, sf):
    p = table(spark, sf, "pages")
    domain = normalize_domain("url")
    return p.select("page_id", domain.alias("domain"), normalize_url("url").alias("clean_url"), lead_id("url").alias("lead_id"), country_hint(domain).alias("country_hint"), is_dach(domain).alias("is_dach"))


PAGES_NORMALIZED = f"""
WITH d AS (SELECT page_id, url, {HOST} AS domain, regexp_extract(regexp_replace(trim(url), '^.*?://', ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM pages)
SELECT page_id, domain, CASE WHEN domain = '' THEN '' ELSE 'https://' || domain || CASE WHEN path = '' THEN '/' ELSE path END END AS clean_url,
  CASE WHEN domain = '' THEN '' ELSE 'lead_' || substr(sha1(domain), 1, 12) END AS lead_id,
  CASE WHEN domain LIKE '%.de' THEN 'DE' WHEN domain LIKE '%.at' THEN 'AT' WHEN domain LIKE '%.ch' THEN 'CH' ELSE '' END AS country_hint,
  domain LIKE '%.de' OR domain LIKE '%.at' OR domain LIKE '%.ch' AS is_dach FROM d"""


def pages_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", pages.html_text("html").alias("text"))
    return p.select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def pages_links(spark, sf):
    links = pages.page_links(pages.read_pages(table(spark, sf, "pages")))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min_by("href", "pos").alias("first_href"), F.max_by("label", "pos").alias("last_label"))


PAGES_LINKS = r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>', 0, 'is') AS a FROM pages)
SELECT page_id, len(a)::BIGINT AS n_links, regexp_extract(a[1], 'href=["'']([^"'']+)["'']', 1, 'is') AS first_href,
  trim(regexp_replace(regexp_replace(a[len(a)], '<[^>]+>', ' ', 'gs'), '[\s\p{Z}]+', ' ', 'g')) AS last_label FROM l WHERE len(a) > 0"""


def pages_discovered(spark, sf):
    links = pages.page_links(pages.read_pages(table(spark, sf, "pages")))
    return pages.discover_page(links, "page_id", ["tion", "keit", "ción"], "/impressum")


PAGES_DISCOVERED = rf"""
WITH l AS (SELECT page_id, {HOST} AS domain, regexp_extract_all(html, '<a\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>', 0, 'is') AS a FROM pages),
r AS (SELECT page_id, domain, unnest(range(1, len(a) + 1)) AS i, a FROM l WHERE len(a) > 0),
h AS (SELECT page_id, domain, i, regexp_extract(a[i], 'href=["'']([^"'']+)["'']', 1, 'is') AS href, lower(trim(regexp_replace(regexp_replace(a[i], '<[^>]+>', ' ', 'gs'), '[\s\p{{Z}}]+', ' ', 'g'))) AS label FROM r),
g AS (SELECT page_id, domain, arg_min(href, i) FILTER (label LIKE '%tion%' OR label LIKE '%keit%' OR label LIKE '%ción%') AS href FROM h GROUP BY page_id, domain)
SELECT page_id, domain, href IS NOT NULL AS discovered,
  CASE WHEN href IS NULL THEN 'https://' || domain || '/impressum' WHEN href LIKE 'http%://%' THEN href WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN 'https://' || domain || href ELSE 'https://' || domain || '/' || href END AS found_url FROM g"""


def marker_hits(spark, sf):
    hits = pages.marker_hits(fetched(spark, sf), WORDS)
    return hits.select("domain", *(F.array_join(f"{f}_hits", "|").alias(f"{f}_hits") for f in WORDS), *(F.col(f"{f}_n") for f in WORDS))


def _hits_sql() -> str:
    words = " UNION ALL ".join(f"SELECT '{f}' AS family, '{w}' AS word" for f, ws in WORDS.items() for w in ws)
    columns = ", ".join(f"coalesce(string_agg(DISTINCT word, '|' ORDER BY word) FILTER (family = '{f}'), '') AS {f}_hits, (count(DISTINCT word) FILTER (family = '{f}'))::INT AS {f}_n" for f in WORDS)
    return f"WITH {SITES}, w AS ({words}), m AS (SELECT p.domain, w.family, w.word FROM p LEFT JOIN w ON contains(lower(p.text), w.word)) SELECT domain, {columns} FROM m GROUP BY domain"


def site_rollup(spark, sf):
    return pages.site_rollup(fetched(spark, sf))


SITE_ROLLUP = f"""WITH {SITES} SELECT domain, count(*) AS requests,
  coalesce(string_agg(path, '|' ORDER BY fetch_order) FILTER (status BETWEEN 200 AND 399 AND html <> ''), '') AS reachable_pages,
  (count(*) FILTER (status BETWEEN 200 AND 399 AND html <> ''))::INT AS n_reachable, string_agg(path || ':' || status, '|' ORDER BY fetch_order) AS checked_pages,
  coalesce(floor(avg(elapsed_ms) FILTER (status <> 0)), 0)::INT AS avg_response_ms, floor(sum(strlen(html)) / 1024)::BIGINT AS total_html_kb,
  coalesce(min(status) FILTER (status <> 0), 0)::INT AS best_status FROM p GROUP BY domain"""


def _verified(spark, sf) -> DataFrame:
    """Sites with their signals, classified and scored by the rules of the care niche."""
    dictionaries = {f: ("text", words) for f, words in WORDS.items()}
    sites = verifications.site_signals(fetched(spark, sf), dictionaries, {}, {}, [], None)
    n = {f: F.size(f) for f in WORDS}
    registered = F.col("best_status") == 404
    kind = classify.classify_site_care(n["product"], n["gkv"], n["process"], n["ratgeber"], n["disqualifier"], registered)
    sites = sites.withColumn("_c", kind).select("*", "_c.*").drop("_c")
    score = classify.fit_score_care(F.col("lead_type"), registered, n["product"], n["gkv"], n["process"], n["insurers"], F.size(F.array_distinct("checked")), is_dach("domain"), F.col("email") != "", F.col("phone") != "")
    sites = sites.withColumn("vhd_fit_score", score)
    sites = sites.withColumn("next_action", classify.next_action_care(F.col("lead_type"), F.col("vhd_fit_score"), registered))
    return sites.withColumns({"grade": classify.grade_care(F.col("lead_type"), F.col("vhd_fit_score"), F.col("exclusion_reason")), "bucket": classify.bucket(F.col("lead_type"), F.col("vhd_fit_score"), F.col("next_action"))})


def site_grades(spark, sf):
    """Flagship: pages to text, markers, roll-up, class, score and grade of each site, best first."""
    out = _verified(spark, sf).select("domain", "requests", "avg_response_ms", "lead_type", "exclusion_reason", "vhd_fit_score", "next_action", "grade", "bucket")
    return out.orderBy(F.desc("vhd_fit_score"), "domain")


def _grades_sql(last: str) -> str:
    hits = _hits_sql()
    return f"""WITH h AS ({hits}), r AS ({SITE_ROLLUP}), {SITES},
e AS (SELECT domain, fetch_order, lower(trim(regexp_extract(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', 0), '.,;:()[]<>')) AS email FROM p),
ph AS (SELECT domain, fetch_order, unnest(regexp_extract_all(text, '(?:\\+49[\\s.\\-/]?|0049|0)[0-9][0-9\\s()./-]{{6,20}}')) AS phone FROM p),
ok AS (SELECT domain FROM ph WHERE NOT regexp_matches(trim(phone, '.,;:()[]<> '), '^[\\s.,;:]*\\d{{1,2}}[./-]\\d{{1,3}}[./-]\\d{{2,4}}[\\s.,;:]*$') AND len(regexp_replace(phone, '\\D', '', 'g')) >= 7 GROUP BY domain),
m AS (SELECT domain FROM e WHERE email <> '' AND NOT regexp_matches(email, '\\.(png|jpg|jpeg|gif|webp|svg)$') GROUP BY domain),
k AS (SELECT r.domain, r.requests, r.avg_response_ms, best_status = 404 AS ik, h.*, len(list_distinct(str_split(checked_pages, '|'))) AS claims,
  r.domain IN (SELECT domain FROM m) AS email, r.domain IN (SELECT domain FROM ok) AS phone FROM r JOIN h USING (domain)),
c AS (SELECT *, CASE WHEN disqualifier_n >= 2 THEN 'service_provider' WHEN ratgeber_n >= 3 AND process_n = 0 AND NOT ik THEN 'ratgeber_site' WHEN ik AND (product_n >= 1 OR process_n >= 1) THEN 'pflegebox_anbieter'
  WHEN product_n >= 2 AND gkv_n >= 2 AND process_n >= 1 THEN 'pflegebox_anbieter' WHEN product_n >= 1 OR process_n >= 1 THEN 'review' ELSE 'rejected' END AS lead_type FROM k),
s AS (SELECT *, CASE lead_type WHEN 'service_provider' THEN 'out_of_icp_business_type' WHEN 'ratgeber_site' THEN 'ratgeber_or_content_site' WHEN 'pflegebox_anbieter' THEN '' WHEN 'review' THEN 'weak_care_signals' ELSE 'no_care_signals' END AS exclusion_reason,
  least(15, 5 * product_n) + least(15, 3 * gkv_n) + least(10, 5 * process_n) + least(10, 2 * insurers_n) + least(10, 4 * claims) + CASE WHEN ik THEN 35 ELSE 0 END
  + CASE WHEN domain LIKE '%.de' OR domain LIKE '%.at' OR domain LIKE '%.ch' THEN 5 ELSE 0 END + CASE WHEN email THEN 4 ELSE 0 END + CASE WHEN phone THEN 3 ELSE 0 END AS raw FROM c),
f AS (SELECT *, (CASE WHEN lead_type IN ('rejected', 'ratgeber_site', 'service_provider') THEN 0 WHEN lead_type = 'review' THEN least(raw, 55) ELSE least(raw, 100) END)::INT AS vhd_fit_score FROM s),
a AS (SELECT *, CASE WHEN lead_type IN ('rejected', 'ratgeber_site', 'service_provider') THEN 'reject' WHEN lead_type = 'review' THEN 'manual_review' WHEN vhd_fit_score >= 85 AND ik THEN 'loom_candidate' WHEN vhd_fit_score >= 65 THEN 'manual_review_high' WHEN ik THEN 'manual_review_ik_verified' ELSE 'manual_review_no_ik' END AS next_action FROM f),
g AS (SELECT *, CASE WHEN lead_type IN ('rejected', 'ratgeber_site', 'service_provider') THEN 'Reject' WHEN lead_type = 'pflegebox_anbieter' THEN CASE WHEN vhd_fit_score >= 75 THEN 'A++' WHEN vhd_fit_score >= 60 THEN 'A+' WHEN vhd_fit_score >= 45 THEN 'A' WHEN vhd_fit_score >= 30 THEN 'B' ELSE 'Review' END ELSE 'Review' END AS grade,
  CASE WHEN lead_type = 'pflegebox_anbieter' AND vhd_fit_score >= 50 THEN 'verified' WHEN lead_type IN ('pflegebox_anbieter', 'review') AND next_action <> 'reject' THEN 'review' ELSE 'rejected' END AS bucket FROM a)
{last}"""


def grade_counts(spark, sf):
    return _verified(spark, sf).groupBy("grade", "bucket").agg(F.count("*").alias("n_sites"), F.max("vhd_fit_score").alias("best_score"))


def shop_verification(spark, sf):
    """The shop niche's class, score, levers, action and grade of each site, with dictionaries of words that occur."""
    p = fetched(spark, sf)
    words = {"shop": ["warenkorb", "thing", "keit"], "strong": ["edthan", "ciónes"], "platform": ["track(5)", "track(7)"], "product": ["schema.org/product", "class=\"ad\""], "shipping": ["versand", "pour", "with"], "legal": ["agb", "sich", "una "]}
    low = p.withColumn("both", F.lower(F.concat_ws(" ", "text", "html")))
    hits = pages.marker_hits(low, words, "both").join(pages.site_rollup(p), "domain").join(pages.site_contacts(p), "domain")
    carts = F.exists(F.split("reachable_pages", r"\|"), lambda x: x.isin(classify.CART_PATHS))
    flags = classify.shop_flags(F.col("n_reachable") > 0, F.col("strong_hits"), F.col("platform_n"), F.col("product_n"), F.col("shop_hits"), carts, F.col("shipping_n"), F.col("legal_n"))
    out = hits.withColumns(flags)
    out = out.withColumn("_c", classify.classify_site(F.col("domain"), F.col("domain"), F.lit(""), F.col("is_shop"), F.col("confirmed_shop"))).select("*", "_c.*")
    tracking = F.array_compact(F.array(F.when(F.col("platform_n") > 0, "gtm"), F.when(F.col("legal_n") > 1, "ga4")))
    score = classify.fit_score(F.col("lead_type"), F.col("is_shop"), F.col("is_woocommerce"), is_dach("domain"), F.col("email") != "", F.col("phone") != "", F.col("product_n") > 0, F.col("shipping_n") > 0, F.size(tracking) > 0, F.col("legal_n") > 0, F.col("avg_response_ms"))
    out = out.withColumns({"vhd_fit_score": score, "possible_shop_levers": F.array_join(classify.levers(F.col("is_shop"), F.col("is_woocommerce"), F.col("product_n") > 0, tracking, F.col("shipping_n") > 0, F.col("legal_n") > 0, F.col("avg_response_ms"), F.col("total_html_kb")), "|")})
    out = out.withColumn("next_action", classify.next_action(F.col("lead_type"), F.col("vhd_fit_score"), F.col("is_woocommerce")))
    grade = classify.grade_shop(F.col("lead_type"), F.col("vhd_fit_score"), F.col("exclusion_reason"), F.lit(""), F.col("is_shop"), F.col("is_woocommerce"), F.col("possible_shop_levers") != "")
    return out.select("domain", "is_shop", "is_woocommerce", "lead_type", "exclusion_reason", "vhd_fit_score", "possible_shop_levers", "next_action", grade.alias("grade"))


#: Dictionaries for the verification query: what they are looked for in, and words that the test pages hold.
VERIFY = {
    "shop": ("both", ["thing", "keit"]), "product": ("html", ["track(5", "track(17"]), "shipping": ("text", ["pour", "with"]), "legal": ("text", ["sich", "una "]), "strong": ("both", ["ciónes", "edthan"]),
    **{f"care_{k}": ("both", words) for k, words in WORDS.items()},
}
_PLATFORMS = {"woocommerce": ["track(7", "track(5"], "shopify": ["track(6"], "jtl": ["<article>"]}
_TRACKING = {"gtm": ["track(8"], "ga4": ['class="ad"'], "klaviyo": ["track(3", "track(4"]}
_CLAIMS = [r"th[a-z]{2} the[a-z]{2}", r"ein [a-z]{3}ung"]


def verification(spark, sf):
    """Every site as a lead, some in cooldown, one never a lead and one without a domain: verification rows of 43 columns."""
    p = fetched(spark, sf)
    leads = p.groupBy("domain").agg(F.min_by("url", "page_id").alias("source_url"), F.min("page_id").alias("k"))
    cooldown = leads.where("k % 10 = 0").select("domain")
    leads = leads.select("domain", "source_url", F.when(F.col("k") % 2 == 0, F.concat(F.lit("Firma "), "k")).otherwise("").alias("company_name"), F.concat(F.lit("+49 30 "), F.col("k") + 1000000).alias("phone"), F.when(F.col("k") % 3 == 0, "at").otherwise("").alias("country_hint"), F.col("k").cast("string").alias("lead_score"), F.lit("in|put").alias("signals"))
    more = table(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "shop.amazon.de").when(F.col("r_regionkey") == 1, "demo.example.de").when(F.col("r_regionkey") == 2, "no-pages.example.ch").otherwise("").alias("domain"), F.lit("").alias("source_url"), F.col("r_name").alias("company_name"), F.lit("").alias("phone"), F.lit("").alias("country_hint"), F.lit("1").alias("lead_score"), F.lit("").alias("signals"))
    return verifications.verify(leads.unionByName(more), p, "t1", cooldown=cooldown, dictionaries=VERIFY, platforms=_PLATFORMS, tracking=_TRACKING, claims=_CLAIMS, labelled=r"track\((\d+)\)")


def _verification_sql() -> str:
    words = " UNION ALL ".join(f"SELECT '{f}' AS family, '{w}' AS word, '{where}' AS place" for f, (where, ws) in VERIFY.items() for w in ws)
    joined = ", ".join(f"coalesce(string_agg(DISTINCT word, '|' ORDER BY word) FILTER (family = '{f}'), '') AS {f}, count(DISTINCT word) FILTER (family = '{f}') AS {f}_n" for f in VERIFY)
    has = lambda w: f"""coalesce(bool_or(contains(h, '{w}')), false)"""
    platform = " ".join(f"WHEN {' OR '.join(map(has, ws))} THEN '{n}'" for n, ws in _PLATFORMS.items())
    shown = " ".join(f"WHEN {' OR '.join(map(has, ws))} THEN concat_ws('|', {', '.join(f"CASE WHEN {has(w)} THEN '{w}' END" for w in ws)})" for ws in _PLATFORMS.values())
    woo = ", ".join(f"CASE WHEN {has(w)} THEN '{w}' END" for w in sorted(_PLATFORMS["woocommerce"]))
    tools = ", ".join(f"CASE WHEN {' OR '.join(map(has, ws))} THEN '{n}' END" for n, ws in sorted(_TRACKING.items()))
    claims = " UNION ALL ".join(f"SELECT domain, {i} AS which, fetch_order, unnest(regexp_extract_all(text, '{c}')) AS said, generate_subscripts(regexp_extract_all(text, '{c}'), 1) AS pos FROM p" for i, c in enumerate(_CLAIMS))
    return rf"""WITH {SITES}, w AS ({words}), t AS (SELECT *, lower(text) AS lt, lower(html) AS h, lower(text) || ' ' || lower(html) AS b FROM p),
m AS (SELECT t.domain, {joined} FROM t LEFT JOIN w ON contains(CASE place WHEN 'text' THEN lt WHEN 'html' THEN h ELSE b END, word) GROUP BY t.domain),
c0 AS ({claims}), c1 AS (SELECT domain, said, min((which, fetch_order, pos)) AS place FROM c0 GROUP BY ALL), c AS (SELECT domain, string_agg(said, '|' ORDER BY place) AS claims, count(*) AS claims_n FROM c1 GROUP BY domain),
e AS (SELECT domain, fetch_order, lower(trim(regexp_extract(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', 0), '.,;:()[]<>')) AS email FROM p),
s AS (SELECT domain, CASE {platform} ELSE '' END AS platform, CASE {shown} ELSE '' END AS shown, concat_ws('|', {woo}) AS woo, concat_ws('|', {tools}) AS tools, count(*) AS requests, min(page_id) AS k, arg_min(url, page_id) AS source_url, arg_min(regexp_extract(html, 'track\((\d+)\)', 1), fetch_order) FILTER (regexp_extract(html, 'track\((\d+)\)', 1) <> '') AS ik,
  coalesce(floor(avg(elapsed_ms) FILTER (status <> 0)), 0)::INT AS ms, floor(sum(strlen(html)) / 1024)::BIGINT AS kb, coalesce(min(status) FILTER (status <> 0), 0) AS best, coalesce(string_agg(path, '|' ORDER BY fetch_order) FILTER (status BETWEEN 200 AND 399 AND html <> ''), '') AS reachable, string_agg(path || ':' || status, '|' ORDER BY fetch_order) AS checked FROM t GROUP BY domain),
j AS (SELECT s.*, m.* EXCLUDE (domain), coalesce(claims, '') AS claims, coalesce(claims_n, 0) AS claims_n, coalesce((SELECT arg_min(email, fetch_order) FROM e WHERE e.domain = s.domain AND email <> '' AND NOT regexp_matches(email, '\.(png|jpg|jpeg|gif|webp|svg)$')), '') AS email,
  k % 3 = 0 OR regexp_matches(s.domain, '\.(de|at|ch)$') AS dach, reachable <> '' AND (strong_n > 0 OR product_n > 0) AS shop_, woo <> '' AS woo_ FROM s JOIN m USING (domain) LEFT JOIN c USING (domain)),
y AS (SELECT *, CASE WHEN care_disqualifier_n >= 2 THEN 'service_provider' WHEN care_ratgeber_n >= 3 AND care_process_n = 0 AND ik IS NULL THEN 'ratgeber_site' WHEN ik IS NOT NULL AND (care_product_n >= 1 OR care_process_n >= 1) THEN 'pflegebox_anbieter' WHEN care_product_n >= 2 AND care_gkv_n >= 2 AND care_process_n >= 1 THEN 'pflegebox_anbieter' WHEN care_product_n >= 1 OR care_process_n >= 1 THEN 'review' ELSE 'rejected' END AS kind,
  least(15, 5 * care_product_n) + least(15, 3 * care_gkv_n) + least(10, 5 * care_process_n) + least(10, 2 * care_insurers_n) + least(10, 4 * claims_n) + CASE WHEN ik IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN dach THEN 5 ELSE 0 END + CASE WHEN email <> '' THEN 4 ELSE 0 END + 3 AS raw FROM j),
z AS (SELECT *, CASE WHEN kind IN ('rejected', 'ratgeber_site', 'service_provider') THEN 0 WHEN kind = 'review' THEN least(raw, 55) ELSE least(raw, 100) END AS score FROM y),
v AS (SELECT *, CASE WHEN kind IN ('rejected', 'ratgeber_site', 'service_provider') THEN 'reject' WHEN kind = 'review' THEN 'manual_review' WHEN score >= 85 AND ik IS NOT NULL THEN 'loom_candidate' WHEN score >= 65 THEN 'manual_review_high' WHEN ik IS NOT NULL THEN 'manual_review_ik_verified' ELSE 'manual_review_no_ik' END AS action,
  CASE WHEN NOT shop_ THEN '' ELSE array_to_string(list_filter([CASE WHEN woo_ THEN 'woocommerce_growth_system' ELSE 'platform_check_needed' END, CASE WHEN tools <> '' THEN 'tracking_stack_visible' ELSE 'tracking_gap_possible' END, CASE WHEN contains(tools, 'gtm') OR contains(tools, 'ga4') THEN 'tracking_check' END, CASE WHEN contains(tools, 'gtm') THEN 'clarity_heatmap_opportunity' END, CASE WHEN contains(tools, 'ga4') AND NOT contains(tools, 'gtm') THEN 'gtm_setup_check' END,
    CASE WHEN contains(tools, 'klaviyo') THEN 'advanced_email_marketing_stack' END, CASE WHEN contains(tools, 'klaviyo') THEN 'reputation_first_approach' END, CASE WHEN product_n = 0 THEN 'product_data_schema_check' END, CASE WHEN shipping_n > 0 THEN 'checkout_payment_shipping_review' ELSE 'checkout_shipping_info_check' END, CASE WHEN legal_n = 0 THEN 'trust_legal_surface_check' END, CASE WHEN ms >= 1200 OR kb >= 900 THEN 'performance_check' END, 'conversion_path_review'], lambda x: x IS NOT NULL), '|') END AS levers FROM z),
good AS (SELECT domain, source_url, CASE WHEN k % 2 = 0 THEN 'Firma ' || k ELSE '' END AS company_name, 'standard' AS scoring_mode, kind AS lead_type, CASE WHEN shop_ THEN 'yes' ELSE 'no' END AS is_shop, CASE WHEN woo_ THEN 'yes' ELSE 'no' END AS is_woocommerce, platform AS detected_platform, shown AS detected_platform_signals, 'pflegebox' AS niche, kind AS care_lead_type, coalesce(ik, '') AS ik_number,
  care_product AS care_product_signals, care_gkv AS care_gkv_signals, care_process AS care_process_signals, care_insurers AS care_insurer_signals, care_ratgeber AS care_ratgeber_signals, care_disqualifier AS care_disqualifier_signals, claims AS scale_indicators, CASE WHEN dach THEN 'yes' ELSE 'no' END AS is_dach, score::VARCHAR AS vhd_fit_score, action AS next_action,
  CASE kind WHEN 'service_provider' THEN 'out_of_icp_business_type' WHEN 'ratgeber_site' THEN 'ratgeber_or_content_site' WHEN 'pflegebox_anbieter' THEN '' WHEN 'review' THEN 'weak_care_signals' ELSE 'no_care_signals' END AS exclusion_reason, email, '+49 30 ' || (k + 1000000) AS phone, reachable AS reachable_pages, checked AS checked_pages, best::VARCHAR AS best_status, ms::VARCHAR AS avg_response_ms, kb::VARCHAR AS total_html_kb, requests::VARCHAR AS http_request_count,
  '' AS robots_status, 'no' AS skipped_by_robots, '' AS policy_skip_reason, concat_ws('|', CASE WHEN shop_ THEN 'shop' END, CASE WHEN woo_ THEN 'woocommerce' END, CASE WHEN dach THEN 'dach' END, CASE WHEN email <> '' THEN 'email' END, 'phone') AS verified_signals,
  array_to_string(list_sort(list_filter(list_concat(str_split(shop, '|'), str_split(strong, '|')), lambda x: x <> '')), '|') AS shop_signals, woo AS woocommerce_signals, tools AS tracking_signals, legal AS legal_trust_signals, levers AS possible_shop_levers, k::VARCHAR AS input_lead_score, 'in|put' AS input_signals, 't1' AS checked_at FROM v WHERE k % 10 <> 0),
bare AS (SELECT 'no-pages.example.ch' AS domain, r_name, 2 AS r FROM region WHERE r_regionkey = 2),
halted AS (SELECT domain, source_url, CASE WHEN k % 2 = 0 THEN 'Firma ' || k ELSE '' END AS name, 'domain_cooldown' AS why, k::VARCHAR AS points, 'in|put' AS signals FROM s WHERE k % 10 = 0
  UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'shop.amazon.de' WHEN 1 THEN 'demo.example.de' ELSE '' END, CASE r_regionkey WHEN 0 THEN 'shop.amazon.de' WHEN 1 THEN 'demo.example.de' ELSE '' END, r_name, CASE r_regionkey WHEN 0 THEN 'blocked_domain:amazon' WHEN 1 THEN 'technical_demo_subdomain' ELSE 'missing_domain' END, '1', '' FROM region WHERE r_regionkey <> 2),
stopped AS (SELECT domain, source_url, name AS company_name, 'standard' AS scoring_mode, CASE WHEN why IN ('domain_cooldown', 'missing_domain') THEN 'skipped' ELSE 'rejected' END AS lead_type, 'no' AS is_shop, 'no' AS is_woocommerce, CASE WHEN regexp_matches(domain, '\.(de|at|ch)$') THEN 'yes' ELSE 'no' END AS is_dach, '0' AS vhd_fit_score, CASE WHEN why IN ('domain_cooldown', 'missing_domain') THEN 'skip' ELSE 'reject' END AS next_action, why AS exclusion_reason, why AS policy_skip_reason, points AS input_lead_score, signals AS input_signals, 't1' AS checked_at FROM halted
  UNION ALL SELECT domain, domain, r_name, 'standard', 'rejected', 'no', 'no', 'yes', '0', 'reject', 'no_care_signals', '', '1', '', 't1' FROM bare),
filled AS (SELECT * FROM good UNION ALL BY NAME SELECT * FROM stopped)
SELECT * REPLACE ({", ".join(f"CASE WHEN domain = 'no-pages.example.ch' THEN '{v}' ELSE coalesce({c}, '') END AS {c}" for c, v in (("niche", "pflegebox"), ("care_lead_type", "rejected"), ("best_status", "0"), ("avg_response_ms", "0"), ("total_html_kb", "0"), ("http_request_count", "0"), ("skipped_by_robots", "no"), ("verified_signals", "dach")))},
  {", ".join(f"coalesce({c}, '') AS {c}" for c in ("detected_platform", "detected_platform_signals", "ik_number", "care_product_signals", "care_gkv_signals", "care_process_signals", "care_insurer_signals", "care_ratgeber_signals", "care_disqualifier_signals", "scale_indicators", "email", "phone", "reachable_pages", "checked_pages", "robots_status", "shop_signals", "woocommerce_signals", "tracking_signals", "legal_trust_signals", "possible_shop_levers"))}) FROM filled"""


def platforms(spark, sf):
    """Tracking tools, platform and signals of each page."""
    p = pages.read_pages(table(spark, sf, "pages"))
    low = F.lower("html")
    found = markers.first_family(low, {"tracker": ["track("], "classic": ["class=\"ad\""], "plain": ["<article>"]})
    return p.select("page_id", found["label"].alias("platform"), F.size(found["terms"]).alias("n_terms"), F.array_join(markers.matching_labels(low, markers.TRACKING), "|").alias("tracking"), F.array_join(search.signals(pages.html_text("html"), F.col("url"), {"de": ["keit"], "en": ["thing"], "en_url": ["/en/"]}), "|").alias("signals"))


PLATFORMS = rf"""WITH t AS (SELECT page_id, lower(html) AS h, lower({TEXT}) || ' ' || lower(url) AS b FROM pages)
SELECT page_id, CASE WHEN contains(h, 'track(') THEN 'tracker' WHEN contains(h, 'class="ad"') THEN 'classic' WHEN contains(h, '<article>') THEN 'plain' ELSE '' END AS platform,
  (CASE WHEN contains(h, 'track(') OR contains(h, 'class="ad"') OR contains(h, '<article>') THEN 1 ELSE 0 END)::INT AS n_terms,
  concat_ws('|', CASE WHEN contains(h, 'brevo') OR contains(h, 'sendinblue') THEN 'brevo' END, CASE WHEN contains(h, 'gtag(') OR contains(h, 'g-') OR contains(h, 'google-analytics.com') THEN 'ga4' END, CASE WHEN contains(h, 'gtm-') OR contains(h, 'googletagmanager.com/gtm.js') THEN 'gtm' END,
    CASE WHEN contains(h, 'hotjar') OR contains(h, 'hjid') THEN 'hotjar' END, CASE WHEN contains(h, 'klaviyo') THEN 'klaviyo' END, CASE WHEN contains(h, 'mailchimp') THEN 'mailchimp' END, CASE WHEN contains(h, 'connect.facebook.net') OR contains(h, 'fbq(') THEN 'meta_pixel' END, CASE WHEN contains(h, 'clarity.ms') OR contains(h, 'clarity(') THEN 'microsoft_clarity' END) AS tracking,
  concat_ws('|', CASE WHEN contains(b, 'keit') THEN 'de' END, CASE WHEN contains(b, 'thing') THEN 'en' END, CASE WHEN contains(b, '/en/') THEN 'en_url' END) AS signals FROM t"""


# --- documents -----------------------------------------------------------------------------------


def docs_emails(spark, sf):
    d = table(spark, sf, "documents").withColumn("emails", contacts.extract_emails("text"))
    return d.where(F.size("emails") > 0).select("doc_id", "source", F.size("emails").alias("n_emails"), F.array_join("emails", "|").alias("emails"), contacts.site_email("text").alias("site_email"))


DOCS_EMAILS = r"""
WITH e AS (SELECT doc_id, source, text, unnest(regexp_extract_all(text, '\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', 0, 'i')) AS email, generate_subscripts(regexp_extract_all(text, '\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', 0, 'i'), 1) AS i FROM documents),
d AS (SELECT doc_id, source, lower(email) AS email, min(i) AS i, any_value(text) AS text FROM e GROUP BY doc_id, source, lower(email))
SELECT doc_id, source, count(*)::INT AS n_emails, string_agg(email, '|' ORDER BY i) AS emails, lower(trim(regexp_extract(any_value(text), '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', 0), '.,;:()[]<>')) AS site_email FROM d GROUP BY doc_id, source"""


def docs_phones(spark, sf):
    """Phone-like numbers by pattern as a parameter, plausible ones only."""
    d = table(spark, sf, "documents").withColumn("phones", contacts.extract_phones("text", r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})"))
    return d.where(F.size("phones") > 0).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size("phones")).alias("n_phones"), F.min(F.get("phones", 0)).alias("first_phone"))


DOCS_PHONES = r"""
WITH p AS (SELECT doc_id, source, list_distinct(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS phones, regexp_extract(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS first FROM documents)
SELECT source, count(*) AS n_docs, sum(len(phones))::BIGINT AS n_phones, min(first) AS first_phone FROM p WHERE len(phones) > 0 GROUP BY source"""


def docs_ids(spark, sf):
    """Identifiers after a label, else near a word; pattern and words are parameters."""
    d = table(spark, sf, "documents")
    found = contacts.registration_id("text", r"(?i)token = \"([0-9a-f]+)", ("rights reserved", "license"), 16)
    return d.select("doc_id", found.alias("found_id")).where(F.col("found_id") != "")


def docs_claims(spark, sf):
    d = table(spark, sf, "documents").withColumn("claims", contacts.scale_claims("text", [r"(?i)all rights reserved", r"(?i)licensed under [a-z]+", r"\b[0-9]{4}-[0-9]{4}\b"]))
    return d.where(F.size("claims") > 0).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("claims")).alias("n_claims"))


DOCS_CLAIMS = r"""
WITH c AS (SELECT lang, list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)all rights reserved'), regexp_extract_all(text, '(?i)licensed under [a-z]+'), regexp_extract_all(text, '\b[0-9]{4}-[0-9]{4}\b')), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS claims FROM documents)
SELECT lang, count(*) AS n_docs, sum(len(claims))::BIGINT AS n_claims FROM c WHERE len(claims) > 0 GROUP BY lang"""


def docs_identities(spark, sf):
    """Legal names, people and addresses found in all documents, per language; the patterns are those for imprints."""
    d = table(spark, sf, "documents")
    d = d.select("lang", contacts.decision_maker("text").alias("who"), contacts.company_identity("text").alias("company"), contacts.address("text").alias("address"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("company.legal_form") != "").alias("with_form"), F.count_if(F.col("company.legal_name") != "").alias("with_name"), F.count_if(F.col("who.name") != "").alias("with_person"), F.count_if(F.col("address") != "").alias("with_address"))


def dictionary_hits(spark, sf):
    """The benchmark's texts, titles of its items' first words, and part names as a dictionary: which documents contain which?"""
    b, p = table(spark, sf, "benchmark"), table(spark, sf, "part")
    opening = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    terms = b.select(F.concat(F.lit("item "), "item_id").alias("term_id"), F.col("text").alias("term"))
    terms = terms.unionByName(b.select(F.concat(F.lit("opening "), "item_id").alias("term_id"), opening.alias("term")))
    terms = terms.unionByName(p.select(F.concat(F.lit("part "), "p_partkey").alias("term_id"), F.col("p_name").alias("term")))
    return dictionary.match_dictionary(table(spark, sf, "documents"), terms, "doc_id", "text", "term_id", "term")


DICTIONARY_HITS = """WITH t AS (SELECT 'item ' || item_id AS term_id, text AS term FROM benchmark UNION ALL SELECT 'opening ' || item_id, array_to_string(str_split(text, ' ')[1:3], ' ') FROM benchmark UNION ALL SELECT 'part ' || p_partkey, p_name FROM part)
SELECT DISTINCT doc_id, term_id FROM documents d JOIN t ON contains(lower(d.text), lower(t.term)) WHERE term <> ''"""


# --- leads ---------------------------------------------------------------------------------------


def _leads(spark, sf) -> DataFrame:
    """``pages`` as lead rows: domain, score, tokens from the URL, order by page_id."""
    p = table(spark, sf, "pages")
    path = F.regexp_replace("url", r"^.*?://[^/]*/", "")
    return p.select(F.col("page_id").alias("ord"), normalize_domain("url").alias("domain"), F.col("url"), (F.col("page_id") % 101).cast("string").alias("vhd_fit_score"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Firma "), F.col("page_id"))).otherwise("").alias("company_name"), F.concat_ws("|", F.split_part(path, F.lit("/"), F.lit(1)), F.when(F.col("page_id") % 2 == 0, "Even").otherwise("odd")).alias("signals"), F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("n"), F.col("page_id"))).otherwise("").alias("notes"))


LEADS = f"""l AS (SELECT page_id AS ord, {HOST} AS domain, url, (page_id % 101)::VARCHAR AS vhd_fit_score, CASE WHEN page_id % 3 = 0 THEN 'Firma ' || page_id ELSE '' END AS company_name,
  split_part(regexp_replace(url, '^.*?://[^/]*/', ''), '/', 1) || '|' || CASE WHEN page_id % 2 = 0 THEN 'Even' ELSE 'odd' END AS signals, CASE WHEN page_id % 7 = 0 THEN 'n' || page_id ELSE '' END AS notes FROM pages)"""


def leads_dedupe(spark, sf):
    return merge.dedupe_leads(_leads(spark, sf))


LEADS_DEDUPE = f"""WITH {LEADS},
r AS (SELECT *, coalesce(vhd_fit_score::INT > max(vhd_fit_score::INT) OVER (PARTITION BY domain ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN up THEN 0 ELSE 1 END, CASE WHEN up THEN -ord ELSE ord END) AS rank FROM r),
t AS (SELECT domain, token, min(ord * 10 + i) AS place FROM (SELECT domain, ord, unnest(str_split(lower(signals), '|')) AS token, generate_subscripts(str_split(signals, '|'), 1) AS i FROM l) WHERE trim(token) <> '' GROUP BY domain, token),
g AS (SELECT domain, string_agg(token, '|' ORDER BY place) AS signals FROM t GROUP BY domain)
SELECT k.domain, min(ord) AS ord, arg_min(url, rank) FILTER (url <> '') AS url, arg_min(vhd_fit_score, rank) FILTER (vhd_fit_score <> '') AS vhd_fit_score, arg_min(company_name, rank) FILTER (company_name <> '') AS company_name,
  any_value(g.signals) AS signals, coalesce(string_agg(notes, ' | ' ORDER BY ord) FILTER (notes <> ''), '') AS notes FROM k JOIN g USING (domain) GROUP BY k.domain"""


def _upsert(spark, sf) -> DataFrame:
    rows = _leads(spark, sf).withColumnRenamed("domain", "domain_key").drop("signals", "notes", "vhd_fit_score")
    stored = merge.incoming_by_domain(rows.where("ord % 2 = 0")).select("domain_key", lead_id("domain_key").alias("lead_id"), "url", F.coalesce("company_name", F.lit("")).alias("company_name"), F.lit("old").alias("source_lists"))
    return merge.upsert_leads(stored, rows.where("ord % 2 = 1"), "odd_pages", "run1", "2026-01-01T00:00:00Z")


def leads_upsert(spark, sf):
    return _upsert(spark, sf).select("domain_key", "lead_id", "url", "company_name", "source_lists", "last_run_id", "duplicate_status", "is_created", F.col("incoming_rows").cast("long").alias("incoming_rows"))


LEADS_UPSERT = f"""WITH {LEADS},
f AS (SELECT domain, ord % 2 AS side, arg_min(url, ord) FILTER (url <> '') AS url, coalesce(arg_min(company_name, ord) FILTER (company_name <> ''), '') AS company_name, count(*) AS n FROM l WHERE domain <> '' GROUP BY domain, ord % 2),
m AS (SELECT * FROM f WHERE side = 0), i AS (SELECT * FROM f WHERE side = 1)
SELECT coalesce(m.domain, i.domain) AS domain_key, 'lead_' || substr(sha1(coalesce(m.domain, i.domain)), 1, 12) AS lead_id, coalesce(m.url, i.url) AS url, coalesce(nullif(m.company_name, ''), i.company_name, '') AS company_name,
  CASE WHEN i.domain IS NULL THEN 'old' WHEN m.domain IS NULL THEN 'odd_pages' ELSE 'old|odd_pages' END AS source_lists, CASE WHEN i.domain IS NULL THEN '' ELSE 'run1' END AS last_run_id,
  CASE WHEN i.domain IS NULL THEN '' ELSE 'canonical' END AS duplicate_status, m.domain IS NULL AS is_created, coalesce(i.n, 0) AS incoming_rows FROM m FULL JOIN i ON m.domain = i.domain"""


def upsert_counts(spark, sf):
    rows = _leads(spark, sf).withColumnRenamed("domain", "domain_key")
    return merge.upsert_counts(rows.where("ord % 2 = 1"), _upsert(spark, sf))


UPSERT_COUNTS = f"""WITH {LEADS}, i AS (SELECT * FROM l WHERE ord % 2 = 1), c AS (SELECT DISTINCT domain FROM i WHERE domain NOT IN (SELECT domain FROM l WHERE ord % 2 = 0))
SELECT count(*) AS records_read, count(*) FILTER (domain = '') AS records_skipped, (SELECT count(*) FROM c) AS records_created, count(*) - (SELECT count(*) FROM c) - count(*) FILTER (domain = '') AS records_updated FROM i"""


def search_merge(spark, sf):
    rows = _leads(spark, sf).withColumns({"score": F.col("vhd_fit_score").cast("int"), "ord": F.col("ord")})
    fold = lambda df: df.groupBy("domain").agg(F.min_by("url", "ord").alias("url"), F.coalesce(F.min_by("company_name", F.when(F.col("company_name") != "", F.col("ord"))), F.lit("")).alias("company_name"), F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("signals", r"\|"))))), "|").alias("signals"))
    stored = fold(rows.where("ord % 2 = 0")).withColumn("last_seen", F.lit("before"))
    return search.merge_search_results(stored, fold(rows.where("ord % 2 = 1")), "now")


SEARCH_MERGE = f"""WITH {LEADS},
f AS (SELECT domain, ord % 2 AS side, arg_min(url, ord) AS url, coalesce(arg_min(company_name, ord) FILTER (company_name <> ''), '') AS company_name, max(vhd_fit_score::INT) AS score FROM l GROUP BY domain, ord % 2),
t AS (SELECT domain, string_agg(DISTINCT token, '|' ORDER BY token) AS signals FROM (SELECT domain, trim(unnest(str_split(signals, '|'))) AS token FROM l) WHERE token <> '' GROUP BY domain),
m AS (SELECT * FROM f WHERE side = 0), i AS (SELECT * FROM f WHERE side = 1)
SELECT coalesce(m.domain, i.domain) AS domain, coalesce(m.url, i.url) AS url, coalesce(nullif(m.company_name, ''), i.company_name, '') AS company_name, greatest(coalesce(m.score, 0), coalesce(i.score, 0)) AS score, coalesce(t.signals, '') AS signals,
  CASE WHEN i.domain IS NULL THEN 'before' ELSE 'now' END AS last_seen, m.domain IS NULL AS is_new FROM m FULL JOIN i ON m.domain = i.domain LEFT JOIN t ON t.domain = coalesce(m.domain, i.domain)"""


def evidence_merge(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.round(F.abs(F.col("value")) % 1, 2).cast("string").alias("confidence"), F.col("event_id").alias("ord"))
    return merge.evidence_winner(e, ["user_id", "field"])


EVIDENCE_MERGE = """WITH e AS (SELECT user_id, event_type AS field, event_id, round(abs(value) % 1, 2) AS c FROM events)
SELECT user_id, field, arg_max(event_id, (c, event_id))::VARCHAR AS value, arg_max(c, (c, event_id))::VARCHAR AS confidence FROM e GROUP BY user_id, field"""


def patch_apply(spark, sf):
    e = table(spark, sf, "events")
    leads = e.groupBy("user_id").agg(F.min("event_id").alias("first_event")).select("user_id", F.when(F.col("user_id") % 2 == 0, "stored").otherwise("").alias("stage"), F.lit("kept").alias("note")).where("user_id % 3 <> 0")
    patches = e.select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("stage"), F.lit("").alias("note"))
    return merge.apply_patches(leads, patches, "user_id", ["stage", "note"])


PATCH_APPLY = """SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (event_id % 4 = 0), CASE WHEN user_id % 2 = 0 THEN 'stored' ELSE '' END) AS stage, 'kept' AS note, true AS is_patched FROM events WHERE user_id % 3 <> 0 GROUP BY user_id"""


def patches_skipped(spark, sf):
    e = table(spark, sf, "events")
    leads = e.where("user_id % 3 <> 0").select("user_id").distinct()
    return merge.unmatched_patches(leads, e.select("user_id", F.col("event_id").alias("ord")), "user_id").groupBy("user_id").agg(F.count("*").alias("n_skipped"))


def first_last_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    first = merge.first_per_key(e, "user_id").select("user_id", F.col("event_type").alias("first_type"), F.col("ord").alias("first_event"))
    last = merge.last_per_key(e, "user_id").select("user_id", F.col("event_type").alias("last_type"), F.col("ord").alias("last_event"))
    return first.join(last, "user_id")


# --- budgets -------------------------------------------------------------------------------------


def cooldown(spark, sf):
    e = table(spark, sf, "events")
    leads = e.select("user_id", "event_type").distinct()
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return budget.cooldown_split(leads, e, ["user_id", "event_type"], now, 14)


COOLDOWN = """SELECT user_id, event_type, max(ts) AS last_checked, CASE WHEN max(ts) > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY THEN 'domain_cooldown' ELSE '' END AS skip_reason FROM events GROUP BY user_id, event_type"""


def check_states(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return budget.latest_checks(e.withColumn("at", F.struct("ts", "event_id")).drop("ts"), ["user_id", "event_type"], "at").select("user_id", "event_type", F.col("at.ts").alias("last_ts"), "event_id")


def daily_usage(spark, sf):
    used = budget.daily_counter(table(spark, sf, "events"), "event_type")
    limits = used.select("event_type").distinct().withColumn("daily_limit", 20 + F.char_length("event_type") * 10)
    return budget.daily_usage(used, limits, "event_type")


DAILY_USAGE = "WITH u AS (SELECT ts::DATE AS day, event_type, count(*) AS used FROM events GROUP BY 1, 2) SELECT day, event_type, used, (20 + len(event_type) * 10)::INT AS daily_limit, greatest(0, 20 + len(event_type) * 10 - used) AS remaining FROM u"


def row_budget(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), "event_type", "user_id")
    return budget.row_budget(e, F.col("event_type") == "purchase", 300).where("selected").select("ord", "event_type", "user_id")


def query_budget(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), (F.col("event_id") % 5).alias("need"))
    return budget.query_budget(e, "need", 5000).select("ord", "need", "granted")


QUERY_BUDGET = "WITH e AS (SELECT event_id AS ord, event_id % 5 AS need FROM events), s AS (SELECT *, coalesce(sum(need) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e) SELECT ord, need, least(need, greatest(0, 5000 - b))::BIGINT AS granted FROM s"


def credit_budget(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), (1 + F.col("event_id") % 3).alias("cost"))
    return budget.credit_budget(e, "cost", 1000).where("runs").select("ord", "cost", F.col("spent_before").cast("long").alias("spent_before"))


CREDIT_BUDGET = "WITH e AS (SELECT event_id AS ord, 1 + event_id % 3 AS cost FROM events), s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM e) SELECT ord, cost, spent_before FROM s WHERE spent_before < 1000"


def queries_until_goal(spark, sf):
    c = table(spark, sf, "conversations").withColumn("cap", budget.query_cap(F.when(F.col("conv_id") % 3 == 0, "A++").when(F.col("conv_id") % 3 == 1, "B").otherwise("A")))
    return budget.queries_until(c, "conv_id", "turn", F.col("text").contains("?") | (F.col("role") == "assistant"), F.max("cap"))


QUERIES_UNTIL = """WITH c AS (SELECT conv_id, min(turn) FILTER (contains(text, '?') OR role = 'assistant') AS f, CASE conv_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 3 END AS cap FROM conversations GROUP BY conv_id)
SELECT conv_id, least(coalesce(f, cap), cap)::BIGINT AS queries_needed, f IS NOT NULL AS goal_reached FROM c"""


def rotation(spark, sf):
    """Query templates over the nations: distinct queries, and the slice of a day from a cursor."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit('"'), F.col("n_name"), F.lit('" site:{tld}')).alias("template"))
    chosen, following = budget.rotate_slice(search.expand_templates(n, {"tld": [".de", ".at", ".ch"]}), 70, 10)
    return chosen.select("query", F.col("turn").cast("long").alias("turn"), F.lit(following).cast("long").alias("next_cursor"))


ROTATION = """WITH q AS (SELECT '"' || n_name || '" site:' || t AS query, row_number() OVER (ORDER BY n_nationkey, i) - 1 AS idx FROM nation, (VALUES (0, '.de'), (1, '.at'), (2, '.ch')) v(i, t))
SELECT query, ((idx - 70 + 75) % 75)::BIGINT AS turn, 5::BIGINT AS next_cursor FROM q WHERE (idx - 70 + 75) % 75 < 10"""


# --- hits and responses --------------------------------------------------------------------------


def hits_summary(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("role").alias("title"), F.col("text").alias("snippet"), F.concat(F.lit("https://"), F.col("role"), F.lit(".example/")).alias("link"))
    return search.summarize_hits(c, "conv_id")


HITS_SUMMARY = r"""WITH c AS (SELECT conv_id, turn, role, substr(trim(regexp_replace(concat_ws(': ', role, text), '[\s\p{Z}]+', ' ', 'g')), 1, 220) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
l AS (SELECT conv_id, 'https://' || role || '.example/' AS link, min(r) AS r FROM c GROUP BY ALL), k AS (SELECT conv_id, string_agg(link, '|' ORDER BY r) AS links FROM l GROUP BY conv_id)
SELECT conv_id, coalesce(string_agg(t, ' | ' ORDER BY r) FILTER (r <= 3 AND t <> ''), '') AS summary, any_value(links) AS links FROM c JOIN k USING (conv_id) GROUP BY conv_id"""


def responses_ingested(spark, sf):
    """Pages as archived search answers: JSON bodies are built, parsed and scored, and hits in blocked places dropped."""
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    hit = F.struct(F.col("url"), title.alias("title"), F.coalesce("html", F.lit("")).alias("description"))
    body = F.to_json(F.struct(F.struct(F.array(hit).alias("results")).alias("web")))
    return search.ingest_search_responses(p.select(F.col("page_id").alias("query_id"), body.alias("body"))).select("query_id", F.col("pos").cast("long").alias("pos"), "domain", "url", "score", F.array_join("signals", "|").alias("signals"))


_FILTER = {"active_shop": ["with", "und "], "cart_checkout": ["thing"], "imprint": ["keit"], "wordpress": ["ción"]}


def search_filter(spark, sf):
    """Pages as search results with dictionaries of words that occur: signals and score from the whole text, blocked hosts and non-shops out."""
    p = table(spark, sf, "pages").select("page_id", "url", normalize_domain("url").alias("domain"), F.lit("").alias("title"), pages.html_text("html").alias("snippet"))
    p = p.withColumn("signals", search.signals(F.col("snippet"), F.col("url"), _FILTER))
    p = p.withColumn("score", search.search_score(F.col("signals"), F.lit(""), F.lit("")))
    kept = search.qualified_leads(p, 20, ["active_shop"], ["casino", "bets"], (["eauaux"], ["thing"], ["keit"]))
    return kept.select("page_id", "domain", "score", F.array_join("signals", "|").alias("signals"))


_HAS = {label: " OR ".join(f"contains(every, '{w}')" for w in words) for label, words in _FILTER.items()}
SEARCH_FILTER = f"""WITH t AS (SELECT page_id, {HOST} AS domain, lower({TEXT}) AS snippet, lower({TEXT}) || ' ' || lower(url) AS every FROM pages),
s AS (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, c in _HAS.items())}) AS signals, ({" + ".join(f"CASE WHEN {c} THEN {search.WEIGHTS[label]} ELSE 0 END" for label, c in _HAS.items())})::INT AS score, ({_HAS["active_shop"]}) AS wanted FROM t)
SELECT page_id, domain, score, signals FROM s WHERE domain <> '' AND NOT regexp_matches(domain, '^(demo|dev|staging|test)\\.') AND NOT contains(domain, 'casino') AND NOT contains(domain, 'bets') AND score >= 20 AND wanted
AND NOT (contains(substr(snippet, 1, 180) || ' ' || domain, 'eauaux') OR (NOT contains(every, 'thing') AND contains(every, 'keit')))"""


def hits_ingested(spark, sf):
    """Turns as archived search answers of two hits, the first without a link; some hits state no position."""
    c = table(spark, sf, "conversations")
    none = F.lit(None)
    bare = F.struct(F.col("role").alias("title"), none.cast("string").alias("link"), none.cast("string").alias("snippet"), none.cast("int").alias("position"))
    link = F.concat(F.lit("https://"), F.col("role"), F.lit(".example/"))
    full = F.struct(F.col("role").alias("title"), link.alias("link"), F.col("text").alias("snippet"), F.when(F.col("role") == "user", F.col("turn").cast("int")).alias("position"))
    body = F.to_json(F.struct(F.array(bare, full).alias("organic")))
    return search.ingest_hits(c.select("conv_id", "turn", body.alias("body"))).select("conv_id", "turn", "title", "link", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"), "position")


HITS_INGESTED = """SELECT conv_id, turn, role AS title, 'https://' || role || '.example/' AS link, md5(coalesce(text, '')) AS snippet_md5, CASE WHEN role = 'user' THEN coalesce(turn::INT, 2) ELSE 2 END AS position
FROM conversations WHERE role IS NOT NULL"""


def research_ingested(spark, sf):
    """Documents as archived research answers: the text as answer, credits stated for one language, hits without an address left out."""
    d = table(spark, sf, "documents")
    hit = lambda url: F.struct(F.col("source").alias("title"), url.alias("url"), F.col("text").alias("content"), F.lit(0.5).alias("score"))
    hits = F.array(hit(F.lit(None).cast("string")), hit(F.concat(F.lit("https://"), F.col("lang"), F.lit(".example/"))))
    usage = F.struct(F.when(F.col("lang") == "de", 2).alias("credits"))
    body = F.to_json(F.struct(F.col("source").alias("query"), F.col("text").alias("answer"), usage.alias("usage"), hits.alias("results")))
    out = search.ingest_research(d.select("doc_id", body.alias("body")))
    return out.select("doc_id", "research_query", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "credits", F.array_join(F.col("hits.url"), "|").alias("urls"))


RESEARCH_INGESTED = """SELECT doc_id, coalesce(source, '') AS research_query, md5(coalesce(text, '')) AS answer_md5, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS credits, coalesce('https://' || lang || '.example/', '') AS urls FROM documents"""


def scrapes_ingested(spark, sf):
    """Pages as archived scrapes; those without a body state no status."""
    p = table(spark, sf, "pages")
    meta = F.struct(F.col("url").alias("sourceURL"), F.when(F.col("html").isNotNull(), 200).alias("statusCode"))
    body = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.col("html").alias("markdown"), meta.alias("metadata")).alias("data")))
    return search.ingest_scrapes(p.select("page_id", body.alias("body"))).select("page_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), "source_url", "title", "status_code", "warning")


SCRAPES_INGESTED = """SELECT page_id, md5(coalesce(html, '')) AS markdown_md5, coalesce(url, '') AS source_url, '' AS title, CASE WHEN html IS NULL THEN 0 ELSE 200 END AS status_code, '' AS warning FROM pages"""


def bodies_checked(spark, sf):
    """Turns as archived search answers, some cut off, empty, or of another shape by the key: how many of each kind, and hits of the good ones."""
    c = table(spark, sf, "conversations")
    hit = F.struct(F.col("role").alias("title"), F.concat(F.lit("https://"), F.col("role"), F.lit(".example/")).alias("link"), F.col("text").alias("snippet"))
    whole = F.to_json(F.struct(F.array(hit).alias("organic")))
    k = F.pmod("conv_id", F.lit(11))
    broken = F.when(k == 1, F.substring(whole, F.lit(1), F.char_length(whole) - 3)).when(k == 2, "<html>502</html>").when(k == 3, None).when(k == 4, " ").when(k == 5, '{"error": "quota"}').when(k == 6, "[1, 2]").when(k == 7, F.concat(whole, F.lit("}")))
    good, bad = search.accept_bodies(c.select("conv_id", "turn", F.when(k.between(1, 7), broken).otherwise(whole).alias("body")), "hits")
    counts = bad.groupBy("reason").agg(F.count("*").alias("n_bodies"), F.sum(F.char_length("body")).alias("n_chars"), F.lit(0).cast("long").alias("n_hits"))
    return counts.unionByName(search.hit_rows(good).agg(F.lit("ok").alias("reason"), F.countDistinct("conv_id", "turn").alias("n_bodies"), F.lit(None).cast("long").alias("n_chars"), F.count("*").alias("n_hits")))


BODIES_CHECKED = """WITH b AS (SELECT conv_id, ((conv_id % 11) + 11) % 11 AS k, json_object('organic', [json_object('title', role, 'link', 'https://' || role || '.example/', 'snippet', text)])::VARCHAR AS whole FROM conversations),
d AS (SELECT k, CASE k WHEN 1 THEN substr(whole, 1, length(whole) - 3) WHEN 2 THEN '<html>502</html>' WHEN 3 THEN NULL WHEN 4 THEN ' ' WHEN 5 THEN '{"error": "quota"}' WHEN 6 THEN '[1, 2]' WHEN 7 THEN whole || '}' ELSE whole END AS body FROM b),
r AS (SELECT body, CASE WHEN body IS NULL THEN 'null' WHEN trim(body) = '' THEN 'blank' WHEN NOT json_valid(body) THEN 'malformed' WHEN json_extract(CASE WHEN json_valid(body) THEN body END, '$.organic') IS NULL THEN 'unexpected' ELSE 'ok' END AS reason FROM d)
SELECT reason, count(*) AS n_bodies, CASE WHEN reason <> 'ok' THEN sum(length(body)) END::BIGINT AS n_chars, count(*) FILTER (reason = 'ok') AS n_hits FROM r GROUP BY reason"""


def mail_export(spark, sf):
    """Documents with an address as rows of the mailing hand-off."""
    email = contacts.site_email("text")
    d = table(spark, sf, "documents").select(email.alias("email"), F.col("source").alias("company_name"), F.concat(F.lit("https://"), F.split_part(email, F.lit("@"), F.lit(2)), F.lit("/")).alias("url"))
    return search.email_export(d)


MAIL_EXPORT = r"""WITH d AS (SELECT source, lower(trim(regexp_extract(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', 0), '.,;:()[]<>')) AS email FROM documents)
SELECT email AS "Email", '' AS "First Name", '' AS "Last Name", source AS "Company", 'https://' || split_part(email, '@', 2) || '/' AS "Website" FROM d WHERE email <> ''"""


def first_urls(spark, sf):
    """For each site the first page whose address holds a token."""
    p = table(spark, sf, "pages").select(normalize_domain("url").alias("domain"), "url", F.col("page_id").alias("fetch_order"))
    return pages.first_matching_url(p, ["/de/", "page=2"])


FIRST_URLS = f"""SELECT {HOST} AS domain, min_by(url, page_id) FILTER (contains(lower(url), '/de/') OR contains(lower(url), 'page=2')) AS matching_url FROM pages GROUP BY ALL"""


def props_json(spark, sf):
    e = table(spark, sf, "events")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return e.select("event_type", F.explode_outer(keys).alias("prop")).groupBy("event_type", "prop").agg(F.count("*").alias("n"))


PROPS_JSON = "WITH k AS (SELECT event_type, unnest(CASE WHEN props IS NULL OR len(json_keys(props)) = 0 THEN [NULL] ELSE json_keys(props) END) AS prop FROM events) SELECT event_type, prop, count(*) AS n FROM k GROUP BY ALL"


# --- scores, plans and gates ---------------------------------------------------------------------

_LEVERS = ["checkout_payment_shipping_review", "tracking_gap_possible", "gtm_setup_check", "performance_check", "advanced_email_marketing_stack"]


def _queue(spark, sf) -> DataFrame:
    """Customers as queue rows: score by balance, type by segment, and attributes left blank by the key."""
    c, n = spread(table(spark, sf, "customer"), "c_custkey"), table(spark, sf, "nation")
    k = F.col("c_custkey")
    blank = lambda condition, value: F.when(condition, value).otherwise("")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "agency").when(F.col("c_mktsegment") == "MACHINERY", "review").otherwise("shop")
    lever = F.get(F.array(*map(F.lit, _LEVERS)), (k % 5).cast("int"))
    score = F.floor(F.abs(F.col("c_acctbal")) / 100).cast("int")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("lead_"), k).alias("lead_id"), F.concat(F.lit("c"), k, F.lit(".example.de")).alias("domain"), F.col("c_name").alias("company_name"), kind.alias("lead_type"), score.cast("string").alias("vhd_fit_score"),
        F.when(k % 4 == 0, "no").otherwise("yes").alias("is_shop"), F.when(k % 3 == 0, "no").otherwise("yes").alias("is_woocommerce"), F.concat_ws("|", lever, F.when(k % 2 == 0, "conversion_path_review")).alias("possible_shop_levers"),
        blank(k % 6 != 0, F.lit("complete")).alias("free_enrichment_status"), blank(k % 5 != 0, F.concat(F.lit("https://c"), k, F.lit("/impressum"))).alias("imprint_url"), F.when(k % 7 == 0, "failed").otherwise("complete").alias("imprint_parse_status"),
        F.when(k % 11 == 0, "0.5").when(k % 11 == 1, "85").otherwise("").alias("confidence_score"), blank(k % 8 != 0, F.lit("Erika Muster")).alias("managing_director_name"), blank(k % 9 == 0, F.lit("true")).alias("entity_ambiguous"), blank(k % 18 == 0, F.lit("true")).alias("tavily_used"),
        blank(k % 14 == 0, F.lit("x")).alias("firecrawl_used"), blank(k % 10 != 0, F.lit("relevant")).alias("why_relevant"), blank(k % 13 == 0, F.concat(F.lit("p"), k, F.lit("@example.de"))).alias("personal_email"), blank(k % 26 == 0, F.lit("ja")).alias("outreach_approved"),
        blank(k % 52 == 0, F.lit("Verified")).alias("email_verification_status"), blank(k % 3 != 1, F.concat(F.lit("+49 30 "), k + 1000000)).alias("phone_main"), blank(k % 31 == 0, F.lit("true")).alias("do_not_contact"), F.lit("").alias("next_enrichment_step"), F.lit("").alias("provider_recommended"),
    )
    return rows.withColumn("lead_quality", classify.lead_quality(rows.columns))


_Q = """q AS (SELECT c_custkey AS k, 'lead_' || c_custkey AS lead_id, floor(abs(c_acctbal) / 100)::INT AS score, CASE c_mktsegment WHEN 'BUILDING' THEN 'agency' WHEN 'MACHINERY' THEN 'review' ELSE 'shop' END AS kind, c_custkey % 4 <> 0 AS shop, c_custkey % 3 <> 0 AS target, c_custkey % 5 AS lever, c_custkey % 2 = 0 AS conv
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, CASE WHEN kind = 'agency' THEN 'C' WHEN target AND shop AND score >= 85 AND (lever IN (0, 1, 3) OR conv) THEN 'A++' WHEN target AND score >= 70 THEN 'A+' WHEN shop AND score >= 60 THEN 'A' WHEN kind = 'review' OR score >= 40 THEN 'B' ELSE 'C' END AS lead_quality FROM q)"""


def quality(spark, sf):
    return _queue(spark, sf).select("lead_id", "lead_type", "vhd_fit_score", "lead_quality")


def pain_scores(spark, sf):
    rows = _queue(spark, sf)
    return rows.select("lead_id", *(c.alias(n) for n, c in classify.pain_scores(rows.columns).items()), classify.outreach_angle(split_tokens("possible_shop_levers", lower=True)).alias("outreach_angle"))


PAIN_SCORES = f"""WITH {_Q},
s AS (SELECT *, least(100, score + CASE WHEN shop THEN 15 ELSE 0 END + CASE WHEN target THEN 15 ELSE 0 END)::INT AS shop_relevance_score, least(100, 20 + 12 + CASE WHEN target THEN 12 ELSE 0 END - CASE WHEN lever = 0 THEN 12 ELSE 0 END)::INT AS technical_pain_score,
  least(100, 15 + CASE WHEN lever = 0 THEN 30 ELSE 0 END + CASE WHEN conv THEN 15 ELSE 0 END)::INT AS conversion_pain_score, least(100, score + CASE WHEN lever = 4 THEN 12 ELSE 0 END + CASE WHEN target AND shop THEN 10 ELSE 0 END)::INT AS business_potential_score FROM w),
o AS (SELECT *, round_even(shop_relevance_score * 0.35::DOUBLE + technical_pain_score * 0.25::DOUBLE + conversion_pain_score * 0.20::DOUBLE + business_potential_score * 0.20::DOUBLE, 0)::INT AS overall_numeric_score FROM s)
SELECT lead_id, shop_relevance_score, technical_pain_score, conversion_pain_score, business_potential_score, overall_numeric_score,
  CASE WHEN kind = 'agency' THEN 'Reject' WHEN NOT shop AND NOT target THEN CASE WHEN overall_numeric_score >= 45 THEN 'Review' ELSE 'Reject' END WHEN overall_numeric_score >= 75 THEN 'A' WHEN overall_numeric_score >= 55 THEN 'B' WHEN overall_numeric_score >= 40 THEN 'C' ELSE 'Review' END AS overall_priority,
  CASE lever WHEN 0 THEN '{classify.ANGLES[0][1]}' WHEN 1 THEN '{classify.ANGLES[1][1]}' WHEN 2 THEN '{classify.ANGLES[2][1]}' WHEN 3 THEN '{classify.ANGLES[4][1]}' ELSE '{classify.ANGLE_ELSE}' END AS outreach_angle FROM o"""


def next_step(spark, sf):
    rows = _queue(spark, sf)
    decision = gates.next_step(gates.Cells(rows.columns), {"serper": True, "firecrawl": True, "tavily": False, "clay": False})
    return rows.withColumn("d", decision).select("lead_id", "lead_quality", F.col("d.next_step").alias("next_step"), F.col("d.status").alias("status"), F.col("d.provider").alias("provider"))


_STEP = """d AS (SELECT *, CASE WHEN lead_quality IN ('B', 'C') THEN 'store_only' WHEN k % 6 = 0 THEN 'free_website_enrichment' WHEN k % 5 = 0 THEN 'serper_find_imprint' WHEN (k % 7 = 0 OR k % 11 = 0) AND k % 14 = 0 THEN 'manual_review' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'firecrawl_extract_known_url'
  WHEN k % 8 = 0 THEN 'serper_find_decision_maker' WHEN k % 9 = 0 AND k % 18 = 0 THEN 'manual_review' WHEN k % 9 = 0 THEN 'tavily_research_ambiguous_entity_planned' WHEN lead_quality = 'A++' AND target AND k % 13 <> 0 AND k % 10 <> 0 AND k % 31 <> 0 THEN 'clay_email_queue_planned' ELSE 'compliance_review' END AS next_step FROM w)"""
NEXT_STEP = f"""WITH {_Q}, {_STEP}
SELECT lead_id, lead_quality, next_step, CASE next_step WHEN 'store_only' THEN 'queued_low_priority' WHEN 'free_website_enrichment' THEN 'queued_free_enrichment' WHEN 'manual_review' THEN 'queued_manual_review' WHEN 'compliance_review' THEN 'queued_compliance_review' WHEN 'tavily_research_ambiguous_entity_planned' THEN 'provider_disabled' WHEN 'clay_email_queue_planned' THEN 'provider_disabled' ELSE 'queued_provider_enrichment' END AS status,
  CASE WHEN next_step LIKE 'serper%' THEN 'serper' WHEN next_step LIKE 'firecrawl%' THEN 'firecrawl' WHEN next_step LIKE 'tavily%' THEN 'tavily' WHEN next_step LIKE 'clay%' THEN 'clay' ELSE '' END AS provider FROM d"""


def final_gate(spark, sf):
    return gates.final_gate(_queue(spark, sf)).select("lead_id", "lead_quality", "compliance_status", "compliance_reason", "outreach_channel", "next_action", "unsubscribe_required", "instantly_ready")


_GATE = f"""WITH {_Q},
c AS (SELECT *, CASE WHEN k % 26 = 0 THEN 'email' WHEN k % 3 <> 1 THEN 'call' ELSE 'manual_review' END AS outreach_channel, k % 52 = 0 AND k % 31 <> 0 AS ready FROM w),
s AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'Lead is marked do-not-contact.' WHEN NOT shop AND NOT target AND lead_quality IN ('B', 'C') THEN 'B2B/shop context is not sufficiently clear.' WHEN lead_quality IN ('B', 'C') THEN 'Lead quality is below enrichment threshold.'
  WHEN k % 11 = 0 THEN 'Source confidence is below 0.70; manual evidence review required.' WHEN k % 10 = 0 THEN 'Concrete WooCommerce/shop relevance note is missing.' WHEN k % 13 = 0 AND NOT ready THEN 'Personal email is present; explicit approval and verified status are required.'
  WHEN k % 3 <> 1 THEN 'Phone-first outreach review is ready with concrete B2B relevance.' WHEN ready THEN 'Email export is explicitly approved and verified for manual upload.' ELSE 'No conservative contact channel is ready.' END AS compliance_reason FROM c),
g AS (SELECT *, CASE WHEN compliance_reason LIKE 'Lead %' OR compliance_reason LIKE 'B2B%' THEN 'do_not_contact' WHEN compliance_reason LIKE 'Phone%' OR compliance_reason LIKE 'Email export%' THEN 'outreach_ready' ELSE 'manual_review' END AS compliance_status FROM s)
"""
FINAL_GATE = _GATE + """SELECT lead_id, lead_quality, compliance_status, compliance_reason, outreach_channel, CASE WHEN outreach_channel = 'email' OR k % 13 = 0 THEN 'true' ELSE 'false' END AS unsubscribe_required, ready AND compliance_status <> 'do_not_contact' AS instantly_ready,
  CASE WHEN compliance_status = 'do_not_contact' THEN 'do_not_contact' WHEN ready THEN 'manual_instantly_upload' WHEN compliance_status = 'outreach_ready' AND outreach_channel = 'call' THEN 'manual_call_review' ELSE 'manual_compliance_review' END AS next_action FROM g"""


def run_summary(spark, sf):
    return gates.run_counts(gates.final_gate(_queue(spark, sf)))


def run_registry(spark, sf):
    """Events as the append-only log of runs, one run for each user: its start and its latest state."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("total"))
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    e = e.withColumn("ord", F.struct("ts", "event_id"))
    return gates.run_states(e).select("run_id", clock("started_at"), clock("ts"), "event_id", "status", "total")


RUN_REGISTRY = """SELECT user_id AS run_id, strftime(min(ts) OVER (PARTITION BY user_id), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, event_type AS status, value AS total
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1"""


LISTS = ["en", "de", "fr", "es", "de"]


def import_runs(spark, sf):
    """Pages as lists of leads, one for each language in the URL, imported one after the other, the last one a second time: the registry's rows."""
    rows = _leads(spark, sf).withColumn("list", F.split_part("signals", F.lit("|"), F.lit(1))).withColumnRenamed("domain", "domain_key").select("list", "ord", "domain_key", "url", "company_name")
    folder = f"{shared_folder(spark)}/imports-{uuid.uuid4().hex}"
    for name in LISTS:
        runs.import_leads(spark, folder, rows.where(F.col("list") == name).drop("list"), name, "t1", 0, ["pages"], lambda: "2026-01-01T00:00:00Z")
    master = read_master(spark, f"{folder}/master").agg(F.count("*").alias("n_leads"), F.count_if(F.col("source_lists").contains("|")).alias("n_of_several_lists"))
    states = runs.registry(spark, f"{folder}/runs").select(F.col("notes").alias("list"), "run_type", "status", "started_at", "finished_at", "input_paths", *runs.COUNTS, "error")
    return states.join(F.broadcast(master))  # one row, from an aggregate without keys


IMPORT_RUNS = f"""WITH {LEADS}, i AS (SELECT split_part(signals, '|', 1) AS list, domain FROM l), k AS (SELECT * FROM (VALUES (1, 'en'), (2, 'de'), (3, 'fr'), (4, 'es')) v(place, list)),
d AS (SELECT domain, min(place) AS first, count(DISTINCT list) AS lists FROM i JOIN k USING (list) WHERE domain <> '' GROUP BY domain),
c AS (SELECT list, place, (SELECT count(*) FROM i WHERE i.list = k.list) AS records_read, (SELECT count(*) FROM d WHERE first <= place) AS records_written, (SELECT count(*) FROM d WHERE first = place) AS records_created,
  (SELECT count(*) FROM i WHERE i.list = k.list AND domain = '') AS records_skipped FROM k)
SELECT r.list, 'scrape_import' AS run_type, 'done' AS status, '2026-01-01T00:00:00Z' AS started_at, '2026-01-01T00:00:00Z' AS finished_at, 'pages' AS input_paths, records_read, records_written, records_created, records_read - records_created - records_skipped AS records_updated, records_skipped, '' AS error,
  (SELECT count(*) FROM d) AS n_leads, (SELECT count(*) FROM d WHERE lists > 1) AS n_of_several_lists
FROM (SELECT list, records_read, records_written, records_created, records_skipped FROM c UNION ALL SELECT 'de', 0, 0, 0, 0) r"""


def enrichment_plan(spark, sf):
    rows = _queue(spark, sf).withColumns({"lead_grade": F.col("lead_quality"), "legal_name": F.when(F.col("phone_main") != "", F.col("company_name")).otherwise(""), "email_general": F.lit("info@example.de"), "decision_maker_1_name": F.col("managing_director_name")})
    return gates.plan_enrichment(rows).select("lead_id", "enrichment_stage", "next_action", "firecrawl_status", "serper_status", "tavily_status")


ENRICHMENT_PLAN = f"""WITH {_Q}, n AS (SELECT *, k % 31 = 0 AS b, k % 5 = 0 OR k % 3 = 1 AS f, lead_quality IN ('A', 'A+', 'A++') AND k % 8 = 0 AS s, lead_quality IN ('A+', 'A++') AND k % 8 = 0 AS t FROM w)
SELECT lead_id, CASE WHEN b THEN 'blocked' ELSE 'planned' END AS enrichment_stage, CASE WHEN b THEN 'none' WHEN NOT f AND NOT s AND NOT t THEN 'review_gate' ELSE concat_ws('|', CASE WHEN f THEN 'website_or_firecrawl_enrichment' END, CASE WHEN s THEN 'serper_decision_maker_research' END, CASE WHEN t THEN 'tavily_manual_research_brief' END) END AS next_action,
  CASE WHEN b THEN 'blocked' WHEN f THEN 'needed' ELSE 'not_needed' END AS firecrawl_status, CASE WHEN b THEN 'blocked' WHEN s THEN 'needed' ELSE 'not_needed' END AS serper_status, CASE WHEN b THEN 'blocked' WHEN t THEN 'needed' ELSE 'not_needed' END AS tavily_status FROM n"""


def handoff(spark, sf):
    rows = _queue(spark, sf).withColumns({"lead_grade": F.col("lead_quality"), "decision_maker_1_name": F.col("managing_director_name"), "clay_status": F.when(F.col("imprint_url") == "", "running").otherwise("")})
    return gates.handoff_queue(rows, "b1", "t1").select("lead_id", "handoff_queued", "handoff_patched", "handoff_status", "handoff_channel", "handoff_reason")


HANDOFF = f"""WITH {_Q}, n AS (SELECT *, k % 31 <> 0 AND lead_quality IN ('A', 'A+', 'A++') AS need, k % 5 = 0 AS active FROM w)
SELECT lead_id, need AND NOT active AS handoff_queued, (need AND NOT active) OR (NOT need AND NOT active) AS handoff_patched, CASE WHEN need AND NOT active THEN 'queued' WHEN NOT need AND NOT active THEN 'not_needed' ELSE 'running' END AS handoff_status,
  CASE WHEN k % 3 <> 1 THEN 'phone' ELSE 'clay_enrich_first' END AS handoff_channel,
  CASE WHEN k % 31 = 0 THEN 'Lead is marked do-not-contact.' WHEN lead_quality IN ('B', 'C') THEN 'B/C leads are not automatically sent to Clay.' WHEN lead_quality = 'A++' THEN 'A++ lead always goes to Clay in phase 1.' WHEN lead_quality = 'A+' AND k % 8 = 0 THEN 'A+ lead is missing a decision maker.' WHEN lead_quality = 'A+' AND k % 3 = 1 THEN 'A+ lead has no business contact path.'
    WHEN lead_quality = 'A+' THEN 'A+ lead is call-ready and stays on the queue.' ELSE 'A lead goes to Clay during the start phase.' END AS handoff_reason FROM n"""


def enrichment_queue(spark, sf):
    """Customers as verified and review rows: one queue with quality, angle and next step."""
    rows = _queue(spark, sf).drop("lead_id", "lead_quality", "why_relevant").withColumn("ord", F.regexp_extract("domain", r"\d+", 0).cast("long"))
    good = F.col("lead_type") == "shop"
    out = queue.build_queue(rows.where(good), rows.where(~good), "now", enabled={"serper": True, "firecrawl": True})
    return out.select("lead_id", "domain", "lead_quality", "next_enrichment_step", "provider_recommended", "input_bucket", "clay_eligible")


def lead_import(spark, sf):
    """Customers imported as a list, then verified: upsert, patch, grades and review states in the master."""
    rows = _queue(spark, sf).select(F.regexp_extract("domain", r"\d+", 0).cast("long").alias("ord"), "domain", "company_name", "lead_type", "vhd_fit_score", "is_shop", "is_woocommerce", "possible_shop_levers")
    empty = rows.select(F.lit("").alias("domain_key"), F.lit("").alias("lead_id")).limit(0)
    imported = patches.scrape_rows(rows.select("ord", "domain", "company_name"))
    master, _ = patches.import_and_merge(empty, imported, patches.verification_patch(rows, "t1"), "customers", "r1", "t1")
    return master.select("domain_key", "lead_id", "company_name", "lead_grade", "verification_status", "domain_alive", "woocommerce_confidence", "review_status", "source_lists")


def _customer_master(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _queue(spark, sf).withColumn("ord", F.regexp_extract("domain", r"\d+", 0).cast("long"))
    empty = rows.select(F.lit("").alias("domain_key"), F.lit("").alias("lead_id")).limit(0)
    return rows, merge.upsert_leads(empty, patches.scrape_rows(rows.select("ord", "domain", "company_name")), "customers", "r1", "t1").drop("is_created", "is_updated", "incoming_rows")


def enrichment_import(spark, sf):
    """Customers imported as a list, then their queue rows imported as enrichment results: evidence, stage and provider states in the master."""
    rows, master = _customer_master(spark, sf)
    k = F.col("ord")
    done = rows.drop("lead_id").withColumns({"niche": F.when(k % 4 == 0, "pflegebox").otherwise(""), "serper_used": F.when(k % 9 == 0, "true").otherwise(""), "provider_recommended": F.when(k % 12 == 0, "serper").otherwise("")})
    out, _ = patches.import_and_merge(master, patches.scrape_rows(rows.select("ord", "domain", "company_name")), patches.enrichment_patch(done, "t2"), "enrichment", "r2", "t2")
    return out.select("domain_key", "lead_grade", "phone_main", "phone_main_source", "phone_main_confidence", "imprint_url", "imprint_url_confidence", "decision_maker_1_name", "decision_maker_1_role", "decision_maker_1_name_source", "pipeline_status", "review_status", "enrichment_stage", "serper_status", "last_completed_step", "last_completed_at", "source_lists")


ENRICHMENT_IMPORT = f"""WITH {_Q}, c AS (SELECT *, CASE k % 11 WHEN 0 THEN '0.5' WHEN 1 THEN '85' ELSE '0.70' END AS sure, k % 8 = 0 AS nobody FROM w)
SELECT 'c' || k || '.example.de' AS domain_key, CASE WHEN k % 4 = 0 THEN '' ELSE lead_quality END AS lead_grade, CASE WHEN k % 3 <> 1 THEN '+49 30 ' || (k + 1000000) ELSE '' END AS phone_main, CASE WHEN k % 3 <> 1 THEN 'lead-enrichment' ELSE '' END AS phone_main_source, CASE WHEN k % 3 <> 1 THEN sure ELSE '' END AS phone_main_confidence,
  CASE WHEN k % 5 <> 0 THEN 'https://c' || k || '/impressum' ELSE '' END AS imprint_url, CASE WHEN k % 5 <> 0 THEN sure ELSE '' END AS imprint_url_confidence, CASE WHEN nobody THEN '' ELSE 'Erika Muster' END AS decision_maker_1_name, CASE WHEN nobody THEN '' ELSE 'Geschaeftsfuehrer' END AS decision_maker_1_role, CASE WHEN nobody THEN '' ELSE 'lead-enrichment' END AS decision_maker_1_name_source,
  CASE WHEN k % 31 = 0 THEN 'do_not_contact' ELSE 'enriched' END AS pipeline_status, CASE WHEN k % 31 = 0 THEN 'do_not_contact' ELSE '' END AS review_status, 'enriched' AS enrichment_stage, CASE WHEN k % 9 = 0 THEN 'done' WHEN k % 12 = 0 THEN 'needed' ELSE '' END AS serper_status, 'enrichment' AS last_completed_step, 't2' AS last_completed_at, 'customers|enrichment' AS source_lists FROM c"""


def handoff_import(spark, sf):
    """Suppliers as results of the hand-off, matched to the customers' leads by lead_id alone: what the master then says of them."""
    _, master = _customer_master(spark, sf)
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    results = s.select(k.alias("ord"), lead_id(F.concat(F.lit("c"), k + 1, F.lit(".example.de"))).alias("lead_id"), F.concat(F.lit("P. "), k).alias("person_name"), F.when(k % 2 == 0, F.concat(F.lit("s"), k, F.lit("@example.de"))).otherwise("").alias("business_email"), F.when(k % 3 == 0, "no_match").otherwise("").alias("status"))
    out, _ = patches.import_and_merge(master, master.limit(0).select(F.lit(0).cast("long").alias("ord"), "domain_key"), patches.handoff_patch(results, "t2"), "clay", "r2", "t2", "lead_id")
    return out.where("clay_status != ''").select("lead_id", "domain_key", "decision_maker_1_name", "decision_maker_1_name_source", "decision_maker_1_name_confidence", "email_general", "email_general_checked_at", "clay_status", "clay_last_synced_at")


HANDOFF_IMPORT = """SELECT 'lead_' || substr(sha1('c' || c_custkey || '.example.de'), 1, 12) AS lead_id, 'c' || c_custkey || '.example.de' AS domain_key, 'P. ' || s_suppkey AS decision_maker_1_name, 'clay' AS decision_maker_1_name_source, '0.70' AS decision_maker_1_name_confidence, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey || '@example.de' ELSE '' END AS email_general,
  CASE WHEN s_suppkey % 2 = 0 THEN 't2' ELSE '' END AS email_general_checked_at, CASE WHEN s_suppkey % 3 = 0 THEN 'no_match' ELSE 'done' END AS clay_status, 't2' AS clay_last_synced_at FROM supplier JOIN customer ON c_custkey = s_suppkey + 1 JOIN nation ON c_nationkey = n_nationkey"""


def queue_page(spark, sf):
    """The second hundred domains of the enrichment queue, in input order."""
    rows = _queue(spark, sf).drop("lead_id", "lead_quality", "why_relevant").withColumn("ord", F.regexp_extract("domain", r"\d+", 0).cast("long"))
    good = F.col("lead_type") == "shop"
    out = queue.build_queue(rows.where(good), rows.where(~good), "now", limit=100, offset=100)
    return out.select("lead_id", "domain", "lead_quality", "input_bucket")


QUEUE_PAGE = f"""WITH {_Q} SELECT 'lead_' || substr(sha1('c' || k || '.example.de'), 1, 12) AS lead_id, 'c' || k || '.example.de' AS domain, lead_quality, CASE WHEN kind = 'shop' THEN 'verified' ELSE 'review' END AS input_bucket
FROM w ORDER BY kind <> 'shop', k LIMIT 100 OFFSET 100"""


def review_needed(spark, sf):
    """Customers whose enrichment a person should look at."""
    rows = _queue(spark, sf).withColumns({"enrichment_status": F.when(F.col("is_shop") == "no", "provider_disabled").otherwise("planned"), "free_enrichment_status": F.col("imprint_parse_status")})
    return rows.where(waterfalls.needs_review()).select("lead_id", "domain", "enrichment_status", "free_enrichment_status")


REVIEW_NEEDED = f"""WITH {_Q} SELECT lead_id, 'c' || k || '.example.de' AS domain, CASE WHEN shop THEN 'planned' ELSE 'provider_disabled' END AS enrichment_status, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'complete' END AS free_enrichment_status FROM q WHERE NOT shop OR k % 7 = 0"""


def known_pages(spark, sf):
    """Each site's pages in the order in which they would be read: those that its lead names first."""
    p = table(spark, sf, "pages").select(normalize_domain("url").alias("domain"), "url", "page_id", F.col("page_id").alias("fetch_order"))
    leads = p.groupBy("domain").agg(F.max_by("url", "page_id").alias("imprint_url"), F.max_by("url", F.when(F.col("page_id") % 2 == 0, F.col("page_id"))).alias("contact_url"))
    out = pages.attach_pages(leads, p, known=("imprint_url", "contact_url"))
    return out.select("domain", "page_id", F.col("page_rank").cast("long").alias("page_rank"))


KNOWN_PAGES = f"""WITH p AS (SELECT {HOST} AS domain, url, page_id FROM pages), l AS (SELECT domain, arg_max(url, page_id) AS imprint_url, arg_max(url, page_id) FILTER (page_id % 2 = 0) AS contact_url FROM p GROUP BY domain)
SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN regexp_matches(regexp_replace(url, '^[a-z]*://[^/?#]*', ''), '^/?([?#].*)?$') THEN -1 WHEN url = imprint_url THEN 0 WHEN url = contact_url THEN 1 ELSE 2 END, page_id) AS page_rank FROM p JOIN l USING (domain)"""


def pages_entities(spark, sf):
    """Each page's text with its character references decoded."""
    text = pages.decode_entities(pages.html_text("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("text")).select("page_id", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _entities_sql() -> str:
    decoded = TEXT
    for name, value in pages.ENTITIES.items():
        decoded = f"replace({decoded}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"WITH t AS (SELECT page_id, {decoded} AS text FROM pages) SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t"


def results_join(spark, sf):
    """Suppliers as hand-off results of customers: by id first, else by domain."""
    leads = _queue(spark, sf).select("lead_id", "domain", "personal_email")
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    results = s.select(F.when(k % 2 == 0, F.concat(F.lit("lead_"), k)).otherwise("").alias("lead_id"), F.concat(F.lit("https://www.C"), k + 1, F.lit(".example.de/")).alias("domain"), F.concat(F.lit("S"), k, F.lit("@example.de")).alias("email"), F.lit("valid").alias("status"), k.alias("ord"))
    return merge.join_handoff_results(leads, results).select("lead_id", "personal_email", "email_verification_status", "email_source", "result_matched")


# a queue that is built anew begins with no provider used
_BEGIN = _STEP.replace(" AND k % 10 <> 0", "").replace("AND k % 14 = 0", "AND false").replace("AND k % 18 = 0", "AND false")
ENRICHMENT_QUEUE = f"""WITH {_Q}, {_BEGIN}
SELECT 'lead_' || substr(sha1('c' || k || '.example.de'), 1, 12) AS lead_id, 'c' || k || '.example.de' AS domain, lead_quality, next_step AS next_enrichment_step,
  CASE WHEN next_step LIKE 'serper%' THEN 'serper' WHEN next_step LIKE 'firecrawl%' THEN 'firecrawl' WHEN next_step LIKE 'tavily%' THEN 'tavily' WHEN next_step LIKE 'clay%' THEN 'clay' ELSE '' END AS provider_recommended,
  CASE WHEN kind = 'shop' THEN 'verified' ELSE 'review' END AS input_bucket, CASE WHEN lead_quality = 'A++' AND target AND k % 8 <> 0 AND k % 13 <> 0 AND k % 31 <> 0 THEN 'true' ELSE 'false' END AS clay_eligible FROM d"""

LEAD_IMPORT = f"""WITH {_Q}, g AS (SELECT q.*, c_name, CASE WHEN kind = 'agency' THEN 'Reject' WHEN target AND score >= 85 THEN 'A++' WHEN target AND score >= 70 THEN 'A+' WHEN shop AND score >= 60 THEN 'A' WHEN shop AND score >= 45 THEN 'B' WHEN kind = 'review' OR score >= 35 THEN 'Review' ELSE 'C' END AS lead_grade FROM q JOIN customer ON c_custkey = k)
SELECT 'c' || k || '.example.de' AS domain_key, 'lead_' || substr(sha1('c' || k || '.example.de'), 1, 12) AS lead_id, c_name AS company_name, lead_grade, 'done' AS verification_status, 'false' AS domain_alive, CASE WHEN target THEN '0.85' ELSE '0.10' END AS woocommerce_confidence,
  CASE WHEN lead_grade = 'Reject' THEN 'rejected' WHEN lead_grade = 'Review' OR kind = 'review' THEN 'manual_review' ELSE '' END AS review_status, 'customers' AS source_lists FROM g"""

RESULTS_JOIN = """WITH l AS (SELECT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT l.k, coalesce(a.s_suppkey, b.s_suppkey) AS s FROM l LEFT JOIN supplier a ON a.s_suppkey = l.k AND l.k % 2 = 0 LEFT JOIN supplier b ON b.s_suppkey + 1 = l.k)
SELECT 'lead_' || k AS lead_id, CASE WHEN s IS NOT NULL THEN 's' || s || '@example.de' WHEN k % 13 = 0 THEN 'p' || k || '@example.de' ELSE '' END AS personal_email, CASE WHEN s IS NULL THEN '' ELSE 'valid' END AS email_verification_status, CASE WHEN s IS NULL THEN '' ELSE 'clay_manual_import' END AS email_source, CASE WHEN s IS NULL THEN 'false' ELSE 'true' END AS result_matched FROM m"""


def planned_queries(spark, sf):
    """The search queries that the customers' next steps need."""
    rows = _queue(spark, sf)
    rows = rows.withColumn("next_enrichment_step", gates.next_step(gates.Cells(rows.columns), {"serper": True})["next_step"]).withColumn("website_url", F.lit("")).withColumn("legal_name", F.lit(""))
    return search.plan_queries(rows).groupBy("lead_id", "purpose").agg(F.count("*").alias("n_queries"), F.min_by("query", "qno").alias("first_query"))


PLANNED_QUERIES = f"""WITH {_Q}, {_STEP} SELECT lead_id, CASE WHEN next_step = 'serper_find_imprint' THEN 'imprint' ELSE 'decision_maker' END AS purpose, CASE WHEN next_step = 'serper_find_imprint' THEN 3 ELSE 4 END::BIGINT AS n_queries,
  'site:c' || k || '.example.de ' || CASE WHEN next_step = 'serper_find_imprint' THEN 'impressum' ELSE '"Geschäftsführer"' END AS first_query FROM d WHERE next_step LIKE 'serper%'"""


def site_facts(spark, sf):
    """Facts of every site from its pages, applied to its queue row."""
    p = fetched(spark, sf).withColumn("status", F.lit(200))
    f = facts.public_facts(p, ("/en/",), ("/de/",))
    queue = f.select("domain").withColumns({"lead_quality": F.lit("A"), "phone_main": F.lit("01.01.2020"), "company_name": F.lit("")})
    return facts.apply_facts(queue, f).select("domain", "phone_main", "imprint_url", "confidence_score", "imprint_parse_status", "free_enrichment_status", F.col("pages_checked").cast("long").alias("pages_checked"))


def single_pass(spark, sf):
    """Scores, quality and the single-pass gate of every customer lead."""
    rows = _queue(spark, sf)
    scores = classify.pain_scores(rows.columns)
    rows = rows.withColumn("priority", scores["overall_priority"])
    c = gates.Cells(rows.columns)
    gate = gates.outreach_gate(F.col("priority"), c.has("phone_main"), c.has("personal_email"), c.yes("is_shop") | c.yes("is_woocommerce"), c.has("why_relevant"), c.yes("do_not_contact"))
    return rows.withColumn("g", gate).groupBy("priority", F.col("g.status").alias("status")).agg(F.count("*").alias("n_leads"))


def single_pass_rows(spark, sf):
    """Every customer lead with its site's facts through the single pass: rows of 48 columns."""
    k = F.regexp_extract("domain", r"\d+", 0).cast("long")
    blank = lambda condition, value: F.when(condition, value).otherwise("")
    site = F.concat(F.lit("https://"), "domain", F.lit("/"))
    rows = _queue(spark, sf).select("domain", "company_name", "lead_type", "vhd_fit_score", "is_shop", "is_woocommerce", "possible_shop_levers", F.col("phone_main").alias("phone"), k.alias("k"))
    rows = rows.withColumns({"email": blank(F.col("k") % 4 == 1, F.concat(F.lit("info@"), "domain")), "company_name": blank(F.col("k") % 5 != 2, F.col("company_name")), "exclusion_reason": blank(F.col("k") % 31 == 0, F.lit("blocked")), "country_hint": blank(F.col("k") % 2 == 0, F.lit("de")), "is_dach": blank(F.col("k") % 3 == 0, F.lit("yes")), "signals": blank(F.col("k") % 5 == 0, F.lit("x|wordpress")), "tracking_signals": blank(F.col("k") % 4 == 0, F.lit("ga4|gtm")), "notes": blank(F.col("k") % 6 == 0, F.concat(F.lit("n"), "k"))})
    named = F.col("k") % 2 == 0
    facts = rows.where("k % 3 <> 2").select("domain", blank(F.col("k") % 7 != 0, F.concat(F.lit("Muster "), "k", F.lit(" GmbH"))).alias("legal_name"), F.lit("GmbH").alias("legal_form"), F.concat(site, F.lit("impressum")).alias("imprint_url"), F.concat(site, F.lit("kontakt")).alias("contact_url"), blank(named, F.lit("Erika Muster")).alias("managing_director_name"), F.when(F.col("k") % 4 == 0, "Inhaber").otherwise("Geschaeftsfuehrer").alias("managing_director_role"), F.lit("post@example.de").alias("general_email"), F.lit("+49 40 1234567").alias("phone_main"), blank(named, F.lit("imprint")).alias("decision_source"), blank(named, F.lit("0.8")).alias("decision_confidence"))
    return single_passes.single_pass(rows.drop("k"), "2026-01-01T00:00:00Z", facts)


_PRIORITY = "CASE WHEN kind = 'agency' OR k % 31 = 0 THEN 'Reject' WHEN NOT shop AND NOT target THEN CASE WHEN overall >= 45 THEN 'Review' ELSE 'Reject' END WHEN overall >= 75 THEN 'A' WHEN overall >= 55 THEN 'B' WHEN overall >= 40 THEN 'C' ELSE 'Review' END"
SINGLE_PASS_ROWS = f"""WITH {_Q},
n AS (SELECT q.*, c_name, 'c' || k || '.example.de' AS domain FROM q JOIN customer ON c_custkey = k),
s AS (SELECT *, least(100, score + CASE WHEN shop THEN 15 ELSE 0 END + CASE WHEN target THEN 15 ELSE 0 END + CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 5 ELSE 0 END)::INT AS relevance, least(100, 20 + 12 + CASE WHEN target THEN 12 ELSE 0 END - CASE WHEN lever = 0 THEN 12 ELSE 0 END)::INT AS technical,
  least(100, 15 + CASE WHEN lever = 0 THEN 30 ELSE 0 END + CASE WHEN conv THEN 15 ELSE 0 END)::INT AS conversion, least(100, score + CASE WHEN lever = 4 THEN 12 ELSE 0 END + CASE WHEN target AND shop THEN 10 ELSE 0 END)::INT AS potential FROM n),
o AS (SELECT *, round_even(relevance * 0.35::DOUBLE + technical * 0.25::DOUBLE + conversion * 0.20::DOUBLE + potential * 0.20::DOUBLE, 0)::INT AS overall FROM s),
p AS (SELECT *, {_PRIORITY} AS priority FROM o),
f AS (SELECT *, priority IN ('A', 'B') AND k % 3 <> 2 AS met, CASE lever WHEN 0 THEN '{classify.ANGLES[0][1]}' WHEN 1 THEN '{classify.ANGLES[1][1]}' WHEN 2 THEN '{classify.ANGLES[2][1]}' WHEN 3 THEN '{classify.ANGLES[4][1]}' ELSE '{classify.ANGLE_ELSE}' END AS angle,
  concat_ws('|', CASE lever {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEVERS))} END, CASE WHEN conv THEN 'conversion_path_review' END) AS levers FROM p),
g AS (SELECT *, met AND k % 7 <> 0 AS imprint, met AND k % 2 = 0 AS person, CASE WHEN k % 3 <> 1 THEN '+49 30 ' || (k + 1000000) WHEN met THEN '+49 40 1234567' ELSE '' END AS phone, CASE WHEN k % 4 = 1 THEN 'info@' || domain WHEN met THEN 'post@example.de' ELSE '' END AS email FROM f),
h AS (SELECT *, CASE WHEN priority IN ('A', 'B') THEN CASE WHEN phone <> '' THEN 'phone_main' ELSE 'manual_linkedin_research' END WHEN email <> '' THEN 'manual_review_generic_email_only' ELSE 'manual_review' END AS channel,
  CASE WHEN k % 31 = 0 OR priority = 'Reject' THEN 'do_not_contact' WHEN priority IN ('A', 'B') AND phone <> '' THEN 'outreach_ready' ELSE 'manual_review' END AS status FROM g),
r AS (SELECT *, CASE status WHEN 'do_not_contact' THEN 'Lead is rejected, excluded, or has a do-not-contact signal.' WHEN 'outreach_ready' THEN 'A/B lead with concrete shop relevance and phone-first channel.' ELSE 'Lead needs manual review before outreach readiness.' END AS reason FROM h)
SELECT 'lead_' || substr(sha1(domain), 1, 12) AS lead_id, domain, 'https://' || domain || '/' AS website_url, CASE WHEN imprint THEN 'Muster ' || k || ' GmbH' WHEN k % 5 <> 2 THEN c_name ELSE 'C' || k END AS company_name,
  CASE WHEN imprint THEN 'website_imprint' WHEN k % 5 <> 2 THEN 'input_csv:company_name' ELSE 'derived_from_domain' END AS company_name_source, CASE WHEN imprint THEN '0.95' WHEN k % 5 <> 2 THEN '0.70' ELSE '0.35' END AS company_name_confidence,
  CASE WHEN imprint THEN 'Muster ' || k || ' GmbH' ELSE '' END AS legal_name, CASE WHEN met THEN 'GmbH' ELSE '' END AS legal_form, '' AS street, '' AS zip, '' AS city, CASE WHEN k % 2 = 0 THEN 'DE' WHEN k % 3 = 0 THEN 'DACH' ELSE '' END AS country,
  CASE WHEN met THEN 'https://' || domain || '/impressum' ELSE '' END AS imprint_url, '' AS register_source, '' AS register_number, CASE WHEN person AND k % 4 <> 0 THEN 'Erika Muster' ELSE '' END AS managing_director, CASE WHEN person AND k % 4 = 0 THEN 'Erika Muster' ELSE '' END AS owner_name,
  CASE WHEN person THEN 'Erika Muster' ELSE '' END AS decision_maker_1_name, CASE WHEN person AND k % 4 <> 0 THEN 'Geschaeftsfuehrer' WHEN person THEN 'Inhaber' WHEN priority IN ('A', 'B') OR target THEN 'Inhaber/Geschaeftsfuehrer oder E-Commerce-Leitung' ELSE 'Inhaber/Geschaeftsfuehrer' END AS decision_maker_1_role,
  CASE WHEN person THEN 'imprint' ELSE '' END AS decision_maker_1_source, CASE WHEN person THEN '0.80' ELSE '' END AS decision_maker_1_confidence, '' AS linkedin_company_url, '' AS linkedin_person_url, phone AS phone_main,
  CASE WHEN k % 3 <> 1 THEN 'input_csv:phone' WHEN met THEN 'website_public_page' ELSE '' END AS phone_main_source, email AS email_general, CASE WHEN k % 4 = 1 THEN 'input_csv:email' WHEN met THEN 'website_public_page' ELSE '' END AS email_general_source, '' AS email_personal, '' AS email_personal_source,
  CASE WHEN met THEN 'https://' || domain || '/kontakt' ELSE '' END AS contact_form_url, concat_ws('|', CASE WHEN target THEN 'woocommerce' END, CASE WHEN k % 5 = 0 THEN 'wordpress' END, CASE WHEN k % 4 = 0 THEN 'ga4|gtm' END) AS technology_stack,
  target::VARCHAR AS woocommerce_detected, (k % 5 = 0)::VARCHAR AS wordpress_detected, relevance::VARCHAR AS shop_relevance_score, technical::VARCHAR AS technical_pain_score, conversion::VARCHAR AS conversion_pain_score, potential::VARCHAR AS business_potential_score, priority AS overall_priority, channel AS recommended_outreach_channel, angle AS outreach_angle,
  CASE WHEN priority IN ('A', 'B') THEN CASE WHEN target THEN 'WooCommerce shop' ELSE 'verified shop' END || ' with documented shop optimization lever: ' || angle || ' Technical growth optimization is offered; business-specific relevance exists; first contact channel recommended: ' || channel || '.'
    ELSE 'Not ready for outreach; manual relevance and channel review required.' END AS mutmassliche_einwilligung_reason,
  CASE WHEN person THEN 'Art. 6(1)(f) GDPR legitimate-interest review required; process only business-relevant data needed for B2B lead review; keep source evidence and allow manual review before outreach.' ELSE 'Company-level enrichment only; if personal data is added later, perform Art. 6(1)(f) GDPR legitimate-interest balancing and keep data minimised.' END AS gdpr_legal_basis_note,
  status AS compliance_status, (status = 'do_not_contact')::VARCHAR AS do_not_contact, CASE WHEN status = 'do_not_contact' THEN reason ELSE '' END AS do_not_contact_reason, '2026-01-01T00:00:00Z' AS last_enriched_at,
  CASE status WHEN 'outreach_ready' THEN 'manual_call_review' ELSE status END AS next_action, concat_ws(' | ', CASE WHEN k % 6 = 0 THEN 'n' || k END, reason, CASE WHEN levers <> '' THEN 'source_levers=' || levers END) AS notes FROM r"""


def _answers(spark, sf) -> dict[str, DataFrame]:
    """Archived answers for the customers, from their keys: imprints and people in search hits, scraped imprints, research."""
    c = spread(table(spark, sf, "customer"), "c_custkey").select(F.concat(F.lit("lead_"), F.col("c_custkey")).alias("lead_id"), F.col("c_custkey").alias("k"))
    site = F.concat(F.lit("https://c"), "k", F.lit(".example.de/"))
    hits = c.select("lead_id", "k", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("qno"))
    good = F.col("k") % 3 + 1 == F.col("qno")
    hits = hits.select("lead_id", "qno", F.lit(1).alias("position"), F.when(good, "Geschäftsführer: Erika Muster").otherwise("Start").alias("title"), F.concat(site, F.when(good, "impressum").otherwise("start")).alias("link"), F.lit("").alias("snippet"))
    scrapes = c.where("k % 7 != 3").select("lead_id", F.concat(F.lit("Impressum Nordlicht GmbH Geschäftsführer: Erika Muster E-Mail: info@c"), "k", F.lit(".example.de")).alias("markdown"), F.concat(site, F.lit("impressum")).alias("source_url"), F.lit("Impressum").alias("title"), F.lit("").alias("warning"))
    result = F.struct(F.lit("Inhaber").alias("title"), site.alias("url"), F.lit("Geschäftsführer: Erika Muster").alias("content"), F.lit("").alias("raw_content"))
    research = c.where("k % 4 != 1").select("lead_id", F.lit("").alias("answer"), F.array(result).alias("hits"), (F.col("k") % 3).cast("int").alias("credits"))
    return {"serper": hits, "firecrawl": scrapes, "tavily": research}


def waterfall(spark, sf):
    """Two rounds of the three providers over the customers' queue, with budgets that a row's need doesn't divide."""
    rows = _queue(spark, sf).withColumn("ord", F.regexp_extract("lead_id", r"\d+", 0).cast("long"))
    done, _ = waterfalls.run_waterfall(rows, _answers(spark, sf), {"serper": 61, "firecrawl": 43, "tavily": 31})
    columns = ["lead_id", "next_enrichment_step", "provider_recommended", "enrichment_status", "imprint_url", "managing_director_name", "managing_director_source", "serper_used", "serper_confidence_score", "firecrawl_used", "firecrawl_confidence_score", "tavily_used", "tavily_confidence_score", "confidence_score", "free_enrichment_status"]
    return done.select(*columns)


def values_parsed(spark, sf):
    """Scalar parsing over event values as text: scores, confidences, tokens, categories."""
    e = table(spark, sf, "events")
    text = F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.when(F.col("event_id") % 3 == 0, "%").otherwise(""))
    return e.groupBy("event_type").agg(F.sum(parse_score(F.col("value").cast("decimal(18,2)").cast("string"))).alias("score_sum"), F.sum(F.rint(parse_confidence(text) * 10000).cast("long")).alias("confidence_sum"), F.sum(clamp_score(F.col("value").cast("decimal(18,2)").cast("double")).cast("long")).alias("clamped_sum"), F.max(merge_tokens(F.lit("a|B"), F.col("event_type"), F.lit("b, a;"))).alias("tokens"), F.max(normalize_category(F.lit("Manual_Review"))).alias("category"))


VALUES_PARSED = """WITH v AS (SELECT event_type, event_id, value::DECIMAL(18,2)::DOUBLE AS v FROM events)
SELECT event_type, sum(trunc(v))::BIGINT AS score_sum, sum(round_even(greatest(0, least(1, CASE WHEN v > 1 THEN v / 100 ELSE v END)) * 10000, 0))::BIGINT AS confidence_sum, sum(greatest(0, least(100, round_even(v, 0))))::BIGINT AS clamped_sum, 'a|B|' || event_type AS tokens, 'Review' AS category FROM v GROUP BY event_type"""


QUERIES = {
    f.__name__: f
    for f in (
        site_grades, grade_counts, pages_normalized, pages_text, pages_links, pages_discovered, marker_hits, site_rollup, shop_verification, verification, platforms,
        docs_emails, docs_phones, docs_ids, docs_claims, docs_identities, dictionary_hits, leads_dedupe, leads_upsert, upsert_counts, search_merge, evidence_merge, patch_apply, patches_skipped, first_last_per_key,
        cooldown, check_states, daily_usage, row_budget, query_budget, credit_budget, queries_until_goal, rotation, hits_summary, responses_ingested, search_filter, hits_ingested, research_ingested, scrapes_ingested, bodies_checked, mail_export, first_urls, props_json,
        quality, pain_scores, next_step, final_gate, run_summary, run_registry, import_runs, enrichment_plan, handoff, enrichment_queue, lead_import, enrichment_import, handoff_import, queue_page, review_needed, known_pages, pages_entities, results_join, planned_queries, site_facts, single_pass, single_pass_rows, waterfall, values_parsed,
    )
}

ORACLE_SQL: dict[str, str] = {
    "site_grades": _grades_sql("SELECT domain, requests, avg_response_ms, lead_type, exclusion_reason, vhd_fit_score, next_action, grade, bucket FROM g"),
    "grade_counts": _grades_sql("SELECT grade, bucket, count(*) AS n_sites, max(vhd_fit_score) AS best_score FROM g GROUP BY grade, bucket"),
    "pages_normalized": PAGES_NORMALIZED,
    "pages_text": f"WITH t AS (SELECT page_id, {TEXT} AS text FROM pages) SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t",
    "pages_links": PAGES_LINKS,
    "pages_discovered": PAGES_DISCOVERED,
    "marker_hits": _hits_sql(),
    "site_rollup": SITE_ROLLUP,
    "verification": _verification_sql(),
    "platforms": PLATFORMS,
    "docs_emails": DOCS_EMAILS,
    "docs_phones": DOCS_PHONES,
    "docs_claims": DOCS_CLAIMS,
    "dictionary_hits": DICTIONARY_HITS,
    "leads_dedupe": LEADS_DEDUPE,
    "leads_upsert": LEADS_UPSERT,
    "upsert_counts": UPSERT_COUNTS,
    "search_merge": SEARCH_MERGE,
    "evidence_merge": EVIDENCE_MERGE,
    "patch_apply": PATCH_APPLY,
    "patches_skipped": "SELECT user_id, count(*) AS n_skipped FROM events WHERE user_id % 3 = 0 GROUP BY user_id",
    "first_last_per_key": "SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS first_event, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_event FROM events GROUP BY user_id",
    "cooldown": COOLDOWN,
    "check_states": "SELECT user_id, event_type, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
    "daily_usage": DAILY_USAGE,
    "row_budget": "SELECT event_id AS ord, event_type, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 300",
    "query_budget": QUERY_BUDGET,
    "credit_budget": CREDIT_BUDGET,
    "queries_until_goal": QUERIES_UNTIL,
    "rotation": ROTATION,
    "hits_summary": HITS_SUMMARY,
    "search_filter": SEARCH_FILTER,
    "hits_ingested": HITS_INGESTED,
    "research_ingested": RESEARCH_INGESTED,
    "scrapes_ingested": SCRAPES_INGESTED,
    "bodies_checked": BODIES_CHECKED,
    "mail_export": MAIL_EXPORT,
    "first_urls": FIRST_URLS,
    "props_json": PROPS_JSON,
    "quality": f"WITH {_Q} SELECT lead_id, kind AS lead_type, score::VARCHAR AS vhd_fit_score, lead_quality FROM w",
    "pain_scores": PAIN_SCORES,
    "next_step": NEXT_STEP,
    "final_gate": FINAL_GATE,
    "run_summary": _GATE + "SELECT compliance_status, count(*) AS n FROM g GROUP BY compliance_status",
    "run_registry": RUN_REGISTRY,
    "import_runs": IMPORT_RUNS,
    "enrichment_plan": ENRICHMENT_PLAN,
    "handoff": HANDOFF,
    "enrichment_queue": ENRICHMENT_QUEUE,
    "lead_import": LEAD_IMPORT,
    "enrichment_import": ENRICHMENT_IMPORT,
    "handoff_import": HANDOFF_IMPORT,
    "queue_page": QUEUE_PAGE,
    "review_needed": REVIEW_NEEDED,
    "known_pages": KNOWN_PAGES,
    "pages_entities": _entities_sql(),
    "results_join": RESULTS_JOIN,
    "planned_queries": PLANNED_QUERIES,
    "single_pass_rows": SINGLE_PASS_ROWS,
    "values_parsed": VALUES_PARSED,
}
