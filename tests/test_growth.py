"""Work that must not grow faster than the input: expressions named once, rows spread over the cores, each distinct term met once."""

import re

from pyspark.sql import functions as F

from tamarack import catalog
from tamarack.functions import contacts, values
from tamarack.operators import dictionary


def test_nested_values_stay_short(spark):
    once, thrice = values.normalize_domain("c"), values.normalize_domain(values.normalize_domain(values.normalize_domain("c")))
    assert len(str(thrice)) < 4 * len(str(once))
    for f in (values.lead_id, values.truthy, values.parse_confidence, values.first_filled, values.normalize_url, lambda c: values.company_name(c, F.lit(""), "d")["name"]):
        assert str(f(F.col("marker"))).count("marker") == 1


def test_master_filter_stays_short(spark):
    plan = catalog.handoff_import(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 2000


def test_queue_rows_are_spread(spark):
    assert catalog._queue(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_white_space(spark):
    texts = ["a b", " a  b ", "a\tb", "a \t b", "a\u00a0b", "a \u2003\u2028 b c\n\n", "", "\n", "a\n b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", values.clean_text("t").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [" ".join(t.split()) for t in texts]


def by_pattern(text):
    for m in re.finditer(r"(?s)(.{0,60}?\b[0-9]{4}\b)", text):
        if "ik" in m[1].lower():
            return m[1][-4:]
    return ""


def test_bare_ids_as_by_the_one_pattern(spark):
    gap = lambda n: ("x " * n)[:n]
    texts = [f"Ik {gap(a)}1234 {gap(b)} IK {gap(c)} 5678 {gap(d)}9012ik 3456" for a in (0, 10, 56, 57, 58, 59, 60) for b in (0, 30) for c in (1, 54, 55, 56, 57, 58) for d in (0, 61)] + ["1234ik 1234", "", "ik 1234", "1234 5678 ik", "IK-12345 6789"]
    out = contacts.registration_id("t", r"never (\d{4})", ("ik",), 4)
    assert "{0,60}" not in str(out)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", out.alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == list(map(by_pattern, texts))


def test_ids_that_share_a_term_meet_a_text_once(spark, monkeypatch):
    counts, plain = {}, dictionary.cut

    def counting(df, name, *folders):
        out = plain(df, name, *folders)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(dictionary, "cut", counting)
    texts = spark.createDataFrame([(1, "a Blue Ring here"), (2, "blue ring blue ring"), (2, "no blue  ring"), (3, None)], "doc int, text string")
    terms = [(i, "blue ring") for i in range(50)] + [(50, "blue ring"), (50, "BLUE RING"), (51, ""), (0, "ring here"), (52, "absent")]
    out = dictionary.match_dictionary(texts, spark.createDataFrame(terms, "id int, term string"), "doc", "text", "id", "term")
    assert sorted(map(tuple, out.collect())) == sorted([(d, i) for d in (1, 2) for i in range(51)])
    assert counts["candidates"] <= 4
