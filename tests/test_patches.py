from tamarack.plans import patches


def test_import_verify_enrich_twice(spark):
    lists = spark.createDataFrame([(1, "https://www.a.example/x", "A"), (2, "b.example", ""), (3, "", "none")], "ord long, shop_url string, title string")
    rows = patches.scrape_rows(lists)
    empty = spark.createDataFrame([], "domain_key string, lead_id string, do_not_contact string, do_not_contact_reason string")
    master, counts = patches.import_and_merge(empty, rows, None, "list", "r1", "t1")
    c = counts.first()
    assert (c.records_created, c.records_skipped) == (2, 1)
    blocked = master.withColumn("do_not_contact", __import__("pyspark").sql.functions.lit("true")).withColumn("do_not_contact_reason", __import__("pyspark").sql.functions.lit("old"))
    checks = spark.createDataFrame([(1, "a.example", "pflegebox", "pflegebox_anbieter", "80", "", "t0"), (2, "b.example", "", "", "0", "domain_cooldown", "")], "ord long, domain string, niche string, care_lead_type string, vhd_fit_score string, policy_skip_reason string, checked_at string")
    checks = checks.withColumn("lead_type", __import__("pyspark").sql.functions.expr("if(policy_skip_reason = '', care_lead_type, 'skipped')"))
    patch = patches.verification_patch(checks, "t2")
    verified, counts = patches.import_and_merge(blocked, patches.scrape_rows(checks), patch, "verify", "r2", "t2")
    assert counts.first().records_created == 0
    got = {r.domain_key: r for r in verified.collect()}
    assert (got["a.example"].lead_grade, got["a.example"].do_not_contact, got["a.example"].do_not_contact_reason) == ("A++", "false", "old")
    assert (got["b.example"].lead_grade, got["b.example"].verification_error, got["b.example"].do_not_contact) == ("", "domain_cooldown", "true")
    facts = spark.createDataFrame([(1, "a.example", "Erika Muster", "info@a.example", "A", "pflegebox", "serper")], "ord long, domain string, managing_director_name string, general_email string, lead_quality string, niche string, provider_recommended string")
    patch = patches.enrichment_patch(facts, "t3")
    enriched, _ = patches.import_and_merge(verified, patches.scrape_rows(facts.drop("lead_quality")), patch, "enrich", "r3", "t3")
    a = {r.domain_key: r for r in enriched.collect()}["a.example"]
    assert (a.decision_maker_1_name, a.decision_maker_1_role, a.email_general_confidence, a.lead_grade, a.serper_status) == ("Erika Muster", "Geschaeftsfuehrer", "0.70", "A++", "needed")
    results = patches.handoff_patch(spark.createDataFrame([(1, a.lead_id, "E. Muster", "0.2")], "ord long, lead_id string, person_name string, x string"), "t4")
    r = results.first()
    assert (r.clay_status, r.decision_maker_1_name_source, r.decision_maker_1_name_confidence) == ("done", "clay", "0.70")
