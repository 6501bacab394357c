"""Legal names by the context of their own place."""

import random

from pyspark.sql import functions as F

from tamarack.functions import contacts


def test_a_name_that_stands_twice_is_rated_where_it_stands(spark):
    gap = "! " + "und noch viele Worte mehr! " * 6
    rows = [
        ("Nord Handel Beispiel GmbH" + gap + "Klein GmbH" + gap + "Impressum: Nord Handel Beispiel GmbH", "Nord Handel Beispiel GmbH"),
        ("Nord Handel Beispiel GmbH" + gap + "Klein Laden GmbH" + gap, "Klein Laden GmbH"),
        ("Impressum Nord Handel Beispiel GmbH" + gap + "Klein Laden GmbH" + gap + "Klein Laden GmbH", "Nord Handel Beispiel GmbH"),
        ("Klein Laden GmbH" + gap + "Nord Handel GmbH" + gap + "Anbieter Klein Laden GmbH" + gap + "Betreiber Nord Handel GmbH", "Klein Laden GmbH"),
        ("", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.name for r in df.select("i", contacts.company_identity("t")["legal_name"].alias("name")).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]


def test_places_of_matches(spark):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab x") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in ("a[ab]*x?", "ab", "[ab]{2,3}", "x"):
        found = F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1))
        got = {r.i: list(r.at) for r in df.select("i", contacts._places(found, F.col("t")).alias("at")).collect()}
        assert [got[i] for i in range(len(texts))] == [[m.start() + 1 for m in re.finditer(pattern, t)] for t in texts]


def test_legal_forms_end_at_a_boundary(spark):
    rows = ["Muster GmbH & Co. KG", "Muster e.K. Inhaber", "Muster e.K.X", "UG (haftungsbeschränkt) X", "UG (haftungsbeschränkt)X", "AGB", "die AG"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.form for r in df.select("i", contacts.legal_form("t").alias("form")).collect()}
    assert [got[i] for i in range(len(rows))] == ["GmbH & Co. KG", "", "e.K.", "", "UG (haftungsbeschränkt)", "", "AG"]
