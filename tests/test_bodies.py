"""Archived bodies: what can be read, what can't and why."""

import json

from tamarack.operators import search

BAD = {
    None: "null", "": "blank", " \n": "blank", "{": "malformed", '{"organic": [}': "malformed", "<html>": "malformed", '{"organic": []}}': "malformed", '{"organic": []} {"organic": []}': "malformed", "{'organic': []}": "malformed",
    "1], [2": "malformed", "1} {": "malformed", "],[": "malformed", "1, 2": "malformed", '{"error": 1}': "unexpected", "[]": "unexpected", "3": "unexpected", '"organic"': "unexpected", "null": "unexpected", '{"organic": null}': "unexpected", '{"organic": 5}': "unexpected",
}


def test_reasons(spark):
    good = [json.dumps({"organic": [{"title": "t", "link": "l", "snippet": "a\n\"é"}, {"title": "no link"}], "more": {"x": [1]}}), '{"organic": []}', ' {"organic": [{"link": "m"}]} ']
    rows = list(enumerate([*BAD, *good]))
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    ok, bad = search.accept_bodies(df, "hits")
    assert {r.id: (r.body, r.reason) for r in bad.collect()} == {i: (b, BAD[b]) for i, b in rows if b in BAD}
    assert {r.id for r in ok.collect()} == {i for i, b in rows if b not in BAD}
    assert sorted((r.title, r.link, r.snippet, r.position) for r in search.hit_rows(ok).collect()) == [("", "m", "", 1), ("t", "l", "a\n\"é", 1)]
    assert search.hit_rows(ok).exceptAll(search.ingest_hits(df)).count() == 0 and search.ingest_hits(df).count() == 2
    scans = ok._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in scans  # both results come from one writing
    for kind, body in (("search", '{"items": []}'), ("search", '{"web": {"results": []}}'), ("research", '{"answer": ""}'), ("scrapes", '{"data": {}}')):
        ok, bad = search.accept_bodies(spark.createDataFrame([(1, body), (2, "{}")], "id long, body string"), kind)
        assert ([r.id for r in ok.collect()], [r.id for r in bad.collect()]) == ([1], [2]), kind
    ok, bad = search.accept_bodies(df.limit(0), "hits")
    assert ok.count() == bad.count() == 0
