from tamarack.plans import queue


def test_queue_of_two_buckets(spark):
    verified = spark.createDataFrame([(1, "a.example", "90", "yes", "yes", "performance_check"), (2, "b.example", "20", "no", "no", "")], "ord long, domain string, vhd_fit_score string, is_shop string, is_woocommerce string, possible_shop_levers string")
    review = spark.createDataFrame([(1, "www.A.example", "95", "x"), (2, "druck-shop.example", "65", "")], "ord long, domain string, vhd_fit_score string, extra string")
    out = queue.build_queue(verified, review, "t", enabled={"serper": True})
    got = {r.domain: r for r in out.collect()}
    assert out.columns[: len(queue.QUEUE_COLUMNS)] == queue.QUEUE_COLUMNS and "extra" in out.columns
    assert (got["a.example"].lead_quality, got["a.example"].vhd_fit_score, got["a.example"].next_enrichment_step) == ("A++", "95", "free_website_enrichment")
    assert got["b.example"].next_enrichment_step == "store_only" and got["druck-shop.example"].company_name == "Druck Shop"
    assert queue.build_queue(verified, review, "t", limit=1).count() == 1


def test_search_results_gain_facts_from_their_pages(spark):
    results = spark.createDataFrame([(1, "a.example", 40, "", "", ["imprint"]), (2, "b.example", 10, "", "", [])], "ord long, domain string, score int, email string, phone string, signals array<string>")
    pages = spark.createDataFrame([("a.example", "https://a.example/", "<p>Warenkorb versandkosten</p>", 1), ("a.example", "https://a.example/impressum", "Mail info@a.example Tel 030 1234567", 2)], "domain string, url string, html string, fetch_order int")
    row = queue.search_site_facts(results, pages, 20, 5).collect()
    assert len(row) == 1 and row[0].email == "info@a.example" and row[0].phone == "030 1234567"
    assert set(row[0].signals) >= {"imprint", "cart_checkout", "active_shop"} and row[0].score == 58
