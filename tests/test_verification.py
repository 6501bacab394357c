"""Verification rows of shop sites: dictionaries, the window at both ends of a site's text, and stops."""

from tamarack.plans import verification


def test_masks_of_many_terms(spark):
    terms = [f"w{i:03d}" for i in range(130)]
    df = spark.createDataFrame([("w000 w059 w060 w129",), ("",), ("w061",)], "t string")
    names = [f"m{i}" for i in range(3)]
    masks = verification.masks(df["t"], terms)
    rows = df.select(*(m.alias(n) for m, n in zip(masks, names))).select(verification.terms_of(names, terms).alias("hits")).collect()
    assert [r.hits for r in rows] == [["w000", "w059", "w060", "w129"], [], ["w061"]]


def test_shop_niche(spark):
    shop = '<div class="add-to-cart">In den Warenkorb</div> <script src="/wp-content/plugins/woocommerce/x.js"></script> Versand Klarna AGB Impressum info@shop.example'
    filler = "wort " * 2400
    pages = [
        ("shop.example", "/", "https://shop.example/", 200, 100, shop, 1), ("shop.example", "/warenkorb", "https://shop.example/warenkorb", 200, 300, "leer", 2), ("shop.example", "/x", "https://shop.example/x", 404, 50, None, 3),
        ("middle.example", "/", "u", 200, 1, filler, 1), ("middle.example", "/m", "u", 200, 1, "wir sind eine agentur", 2), ("middle.example", "/z", "u", 200, 1, filler, 3),
        ("end.example", "/", "u", 200, 1, filler, 1), ("end.example", "/z", "u", 200, 1, "wir sind eine agentur " + "wort " * 390, 2),
        ("start.example", "/", "u", 200, 1, "wir sind eine agentur " + filler, 1), ("down.example", "/", "u", 0, 0, "", 1), ("other.example", "/", "u", 200, 1, "cdn.shopify.com zur kasse", 1),
    ]
    pages = spark.createDataFrame(pages, "domain string, path string, url string, status int, elapsed_ms int, html string, fetch_order int").repartition(4)
    names = ["shop.example", "middle.example", "end.example", "start.example", "down.example", "other.example", "none.example", "www.google.com", "", "wait.example"]
    leads = spark.createDataFrame([(n, "own@mail.example" if n == "down.example" else "") for n in names], "domain string, email string")
    cooldown = spark.createDataFrame([("https://www.wait.example/",), ("wait.example",)], "domain string")
    rows = verification.verify(leads, pages, "t1", niche="shop", cooldown=cooldown)
    assert rows.columns == verification.VERIFIED_COLUMNS
    got = {r.domain: r for r in rows.collect()}
    assert len(got) == len(names) == rows.count()
    s = got["shop.example"]
    assert (s.lead_type, s.is_shop, s.is_woocommerce, s.detected_platform, s.email, s.reachable_pages, s.checked_pages, s.best_status, s.avg_response_ms) == ("shop", "yes", "yes", "woocommerce", "info@shop.example", "/|/warenkorb", "/:200|/warenkorb:200|/x:404", "200", "150")
    assert "/warenkorb" in s.shop_signals.split("|") and "agb" in s.legal_trust_signals and s.care_lead_type == "" and s.verified_signals == "shop|woocommerce|email"
    assert (got["middle.example"].lead_type, got["middle.example"].exclusion_reason) == ("unknown", "not_enough_shop_signals")
    assert got["end.example"].exclusion_reason == got["start.example"].exclusion_reason != "not_enough_shop_signals"
    assert (got["other.example"].lead_type, got["other.example"].exclusion_reason) == ("non_target_platform", "platform_shopify")
    assert (got["down.example"].lead_type, got["down.example"].email, got["down.example"].http_request_count) == ("unknown", "own@mail.example", "1")
    assert (got["none.example"].http_request_count, got["none.example"].next_action) == ("0", "manual_review")
    assert [(got[d].lead_type, got[d].policy_skip_reason) for d in ("www.google.com", "google.com", "", "wait.example") if d in got] == [("rejected", "blocked_domain:google"), ("skipped", "missing_domain"), ("skipped", "domain_cooldown")]
