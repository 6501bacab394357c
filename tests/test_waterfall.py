"""The provider waterfall against a fold in plain Python, row by row."""

from tamarack.plans import waterfall as w

QUALITY = ["A++", "A+", "A", "B"]


def rows(n):
    out = []
    for k in range(n):
        out.append({
            "lead_id": f"l{k}", "ord": k, "domain": f"c{k}.example", "company_name": "" if k % 6 == 5 else f"Firma {k}", "lead_quality": QUALITY[k % 4], "is_woocommerce": "true" if k % 3 else "", "free_enrichment_status": "complete",
            "imprint_url": f"https://c{k}.example/impressum" if k % 5 < 2 else ("https://other.example/impressum" if k % 5 == 2 and k % 2 else ""), "imprint_parse_status": "failed" if k % 7 in (1, 2) else "complete", "confidence_score": "0.90",
            "managing_director_name": "Hans Beispiel" if k % 4 == 2 else "", "entity_ambiguous": "true" if k % 9 == 2 else "", "why_relevant": "x",
        })
    return out


def answers(n):
    hits = [(f"l{k}", q, 1, "Geschäftsführer: Erika Muster" if k % 3 + 1 == q else "Start", f"https://c{k}.example/{'impressum' if k % 3 + 1 == q else 'start'}", "") for k in range(n) for q in (1, 2, 3)]
    scrapes = [(f"l{k}", "Impressum Nordlicht GmbH Geschäftsführer: Erika Muster", f"https://c{k}.example/impressum", "T", "") for k in range(n) if k % 7 != 1]
    research = [(f"l{k}", "", k % 3) for k in range(n) if k % 4]
    return hits, scrapes, research


def decided(r):
    """The provider that a row waits for, in plain Python; only what these rows can meet."""
    if r["q"] == "B":
        return ""
    if not r["imprint"]:
        return "serper_imprint"
    if r["weak"]:
        return "" if r["scraped"] else "firecrawl"
    if not r["person"]:
        return "serper_person"
    if r["unclear"]:
        return "" if r["researched"] else "tavily"
    return ""


def fold(n, limits, rounds):
    state = [{"q": x["lead_quality"], "imprint": x["imprint_url"], "own": f"c{k}." in x["imprint_url"], "weak": x["imprint_parse_status"] == "failed", "person": x["managing_director_name"], "unclear": bool(x["entity_ambiguous"]), "name": bool(x["company_name"]), "scraped": False, "researched": False} for k, x in enumerate(rows(n))]
    used, report = {"serper": 0, "firecrawl": 0, "tavily": 0}, []
    for turn in range(1, rounds + 1):
        for p in used:
            waiting = [k for k, r in enumerate(state) if decided(r).startswith(p)]
            if not waiting:
                continue
            limit, spent, served = limits[p] - used[p], 0, 0
            if limit <= 0:
                report.append((turn, p, "skipped", 0, 0))
                continue
            for k in waiting:
                r = state[k]
                if spent >= limit:
                    continue
                if p == "serper":
                    imprint = decided(r) == "serper_imprint"
                    planned = (3 if r["name"] else 2) if imprint else (4 if r["name"] else 2)
                    need = min(planned, 4 if r["q"] == "A++" else 3, k % 3 + 1)
                    cost = min(need, limit - spent)
                    if cost == k % 3 + 1:
                        r["imprint" if imprint else "person"] = "Erika Muster" if not imprint else f"https://c{k}.example/impressum"
                        r["own"] = r["own"] or imprint
                        r["weak"] = r["weak"] and not imprint  # the status says where the address comes from
                elif p == "firecrawl":
                    if not r["own"]:
                        continue
                    cost, r["scraped"] = 1, True
                    if k % 7 != 1:
                        r["weak"], r["person"] = False, r["person"] or "Erika Muster"
                else:
                    cost, r["researched"] = max(1, k % 3) if k % 4 else 1, True
                    r["person"] = r["person"] if k % 4 == 0 else r["person"]
                spent, served = spent + cost, served + 1
            used[p] += spent
            report.append((turn, p, "completed", served, spent))
    return state, report


def test_waterfall_against_a_fold(spark):
    n, limits = 90, {"serper": 40, "firecrawl": 11, "tavily": 3}
    queue = spark.createDataFrame(rows(n)).repartition(3)
    hits, scrapes, research = answers(n)
    tables = {
        "serper": spark.createDataFrame(hits, "lead_id string, qno int, position int, title string, link string, snippet string"),
        "firecrawl": spark.createDataFrame(scrapes, "lead_id string, markdown string, source_url string, title string, warning string"),
        "tavily": spark.createDataFrame(research, "lead_id string, answer string, credits int").selectExpr("*", "array(named_struct('title', 'x', 'url', 'https://x.example', 'content', 'y', 'raw_content', '')) AS hits"),
    }
    out, report = w.run_waterfall(queue, tables, limits, rounds=2)
    state, want = fold(n, limits, 2)
    assert [(s["round"], s["provider"], s["status"], s["rows"], s["spent"]) for s in report] == want
    spent = {p: sum(s[4] for s in want if s[1] == p) for p in limits}
    assert spent["serper"] == 40 and spent["firecrawl"] <= 11
    got = {r.lead_id: r for r in out.collect()}
    for k, r in enumerate(state):
        g = got[f"l{k}"]
        assert (g.imprint_url, g.managing_director_name, g.firecrawl_used == "true", g.tavily_used == "true") == (r["imprint"], r["person"], r["scraped"], r["researched"]), k
        step = decided(r)
        assert g.provider_recommended in ({"serper_imprint": ["serper"], "serper_person": ["serper"]}.get(step, [step] if step else ["", "clay"])), k
    failed = got["l1"]
    assert failed.firecrawl_used != "true" or failed.free_enrichment_status == "failed"


def test_disabled_and_empty(spark):
    queue = spark.createDataFrame(rows(12))
    hits, scrapes, research = answers(12)
    none = {"serper": spark.createDataFrame(hits, "lead_id string, qno int, position int, title string, link string, snippet string").limit(0)}
    out, report = w.run_waterfall(queue, none, {"serper": 5}, {"serper": False}, rounds=2)
    assert report and all(s["status"] == "skipped" for s in report) and len(report) <= 3
    assert out.where(w.needs_review()).count() > 0
