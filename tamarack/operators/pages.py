"""Jobs over fetched pages: text, links, discovered pages, and roll-ups by site.

Signals are found page by page and then gathered by site, so no site's text is concatenated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, markers
from ..functions.values import absolute_url, as_col, clean_text, has, lead_id, normalize_domain, normalize_url

# Entities that are decoded; numeric ones are decoded by rule.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&euro;": "€", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def html_text(html: Column | str) -> Column:
    """Text of a page: scripts and styles dropped with their content, tags to spaces, white space collapsed."""
    t = F.coalesce(as_col(html), F.lit(""))
    for tag in ("script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{tag}.*?>.*?</{tag}>", " ")
    return clean_text(F.regexp_replace(t, r"(?s)<[^>]+>", " "))


def decode_entities(text: Column | str) -> Column:
    """Named entities of the fixed list and numeric ones; others stay as they are."""
    t = F.coalesce(as_col(text), F.lit(""))
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#([0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"), F.lit(1)))

    def sign(code: Column) -> Column:
        number = F.when(F.lower(code).startswith("x"), F.conv(F.substring(code, 2, 9), 16, 10)).otherwise(code).try_cast("int")
        wide = F.lpad(F.hex(number), 8, "0")
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.decode(F.unhex(wide), "UTF-32")).otherwise("�")

    t = F.aggregate(codes, t, lambda a, c: F.replace(a, F.concat(F.lit("&#"), c, F.lit(";")), sign(c)))
    for name, value in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def read_pages(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Fetched pages with their site: domain, lead_id, clean_url, and html whole, or up to ``most`` characters where a crawler's limit is asked for."""
    html = F.coalesce("html", F.lit(""))
    return pages.withColumns({"domain": normalize_domain("url"), "lead_id": lead_id("url"), "clean_url": normalize_url("url"), "html": html if most is None else F.substring(html, 1, most)})


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each anchor with an address: key, pos, href and label text, in order."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r'(?is)(<a\b[^>]*href=["\'][^"\']+["\'][^>]*>.*?</a>)'), F.lit(1))
    link = pages.select(key, "domain", F.posexplode(found).alias("pos", "anchor"))
    href = F.regexp_extract("anchor", r'(?is)href=["\']([^"\']+)["\']', 1)
    return link.select(key, "domain", "pos", href.alias("href"), html_text("anchor").alias("label"))


def discover_page(links: DataFrame, key: str, tokens: list[str], default: str) -> DataFrame:
    """For each key the address of the first link whose label holds a token; else ``default`` on its domain."""
    hit = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.lower("label").contains(t))
    found = links.groupBy(key, "domain").agg(F.min_by("href", F.when(hit, F.col("pos"))).alias("href"), F.count_if(hit).alias("hits"))
    return found.select(key, "domain", F.when(F.col("hits") > 0, absolute_url("domain", "href")).otherwise(absolute_url("domain", F.lit(default))).alias("found_url"), (F.col("hits") > 0).alias("discovered"))


def attach_pages(leads: DataFrame, pages: DataFrame, most: int | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """Leads with their domain's pages (domain, url, fetch_order, ...) and each page's ``page_rank``: a site's start page first, then the addresses
    that the lead itself names in the ``known`` columns, in their order, then the others by ``fetch_order``.

    With ``most`` only so many pages of each lead stay, as a crawler's limit would have it; without it all of them do.
    """
    joined = leads.join(pages, "domain")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]*://[^/?#]*", ""), r"[?#].*$", "")
    place = F.when(path.isin("", "/"), -1)
    for i, c in enumerate(known):
        place = place.when(has(c) & (F.col("url") == F.col(c)), i)
    ranked = joined.withColumn("_place", place.otherwise(len(known)))
    rank = F.expr("row_number() OVER (PARTITION BY domain ORDER BY _place, fetch_order)")
    ranked = ranked.withColumn("page_rank", rank).drop("_place")
    return ranked if most is None else ranked.where(F.col("page_rank") <= most)


def first_matching_url(pages: DataFrame, tokens: list[str]) -> DataFrame:
    """For each domain the first page, by ``fetch_order``, whose address holds a token."""
    hit = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.lower("url").contains(t))
    return pages.groupBy("domain").agg(F.min_by("url", F.when(hit, F.col("fetch_order"))).alias("matching_url"))


def marker_hits(pages: DataFrame, families: dict[str, list[str]], text: str = "text", key: str = "domain") -> DataFrame:
    """For each key and family the sorted distinct terms met on its pages, and how many (columns <family>_hits, <family>_n)."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    per_page = pages.select(key, *(markers.matching_terms(lower, terms).alias(f) for f, terms in families.items()))
    gathered = per_page.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(f)))).alias(f"{f}_hits") for f in families))
    return gathered.select(key, *(F.col(f"{f}_hits") for f in families), *(F.size(f"{f}_hits").alias(f"{f}_n") for f in families))


def site_rollup(pages: DataFrame) -> DataFrame:
    """For each domain: requests, reachable paths, path:status list, mean ms over answers, KB, least status, failing statuses.

    Takes domain, path, status, elapsed_ms, html and fetch_order.
    """
    ok = (F.col("status") >= 200) & (F.col("status") < 400) & (F.col("html") != "")
    one = F.struct("fetch_order", "path", "status")
    every = F.array_sort(F.collect_list(one))
    grouped = pages.groupBy("domain").agg(
        F.count("*").alias("requests"),
        every.alias("every"),
        F.array_sort(F.collect_list(F.when(ok, one))).alias("good"),
        F.coalesce(F.floor(F.avg(F.when(F.col("status") != 0, F.col("elapsed_ms")))).cast("int"), F.lit(0)).alias("avg_response_ms"),
        F.floor(F.sum(F.octet_length("html")) / 1024).alias("total_html_kb"),
        F.coalesce(F.min(F.when(F.col("status") != 0, F.col("status"))), F.lit(0)).alias("best_status"),
    )
    joined = F.array_join(F.transform("every", lambda s: F.concat_ws(":", s["path"], s["status"])), "|")
    return grouped.select("domain", "requests", F.array_join(F.transform("good", lambda s: s["path"]), "|").alias("reachable_pages"), F.size("good").alias("n_reachable"), joined.alias("checked_pages"), "avg_response_ms", "total_html_kb", "best_status")


def site_contacts(pages: DataFrame) -> DataFrame:
    """For each domain the first address and number over its pages in order (text column ``text``)."""
    per_page = pages.select("domain", "fetch_order", contacts.site_email("text").alias("email"), contacts.site_phone("text").alias("phone"))
    pick = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("fetch_order"))), F.lit("")).alias(c)
    return per_page.groupBy("domain").agg(pick("email"), pick("phone"))
