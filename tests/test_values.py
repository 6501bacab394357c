import pytest
from pyspark.sql import functions as F

from tamarack.functions import contacts, values


def run(spark, expression, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (values.clean_text, [(None, ""), ("  a  b\tc ", "a b c")]),
    (values.truthy, [("Ja", True), ("nein", False), ("", False), (None, False), ("maybe", True), ("0", False)]),
    (values.parse_score, [("3,7", 3), ("x", 0), ("1e2", 100), ("5d", 0), ("nan", 0), ("-2.9", -2), (None, 0)]),
    (values.parse_confidence, [("85%", 0.85), ("0.4", 0.4), ("250", 1.0), ("", 0.0), ("-1", 0.0)]),
    (lambda c: values.confidence_percent(c, 100), [("0.5", 50), ("85", 85), ("", 100), ("0.005", 0), ("0.015", 2)]),
    (values.normalize_domain, [("https://www.Shop.example.de:8080/a?b", "shop.example.de"), ("mail@shop.example.de", "shop.example.de"), ("user@host.example/x", "host.example"), ("", ""), ("my_host.example.", "my_host.example"), ("münchen.example/x", "münchen.example")]),
    (values.normalize_url, [("http://www.a.example/p?q#f", "https://a.example/p"), ("a.example", "https://a.example/"), ("", "")]),
    (values.lead_id, [("https://www.a.example", "lead_" + __import__("hashlib").sha1(b"a.example").hexdigest()[:12]), ("", "")]),
    (lambda c: values.merge_tokens(c, F.lit("b|C")), [("a, B;a", "a|B|C"), (None, "b|C")]),
    (values.valid_email, [("a@b.c", True), ("a@b", False), ("a b@c.d", False), (None, False)]),
    (values.normalize_category, [("Excluded", "Reject"), ("a++", "A++"), ("other", "other")]),
    (lambda c: values.company_name(F.lit("Home"), c, F.lit("druck-shop24x.example.de"))["name"], [("Shop", "Druck Shop24X"), ("Muster | Start", "Muster")]),
    (contacts.general_email, [("x.y@a.example Info@a.example", "info@a.example"), ("x.y@a.example", "")]),
    (contacts.main_phone, [("seit 01.01.2020", "01.01.2020"), ("am 01.2020", ""), ("Tel.: 030 1234567 oder 040 7654321", "030 1234567"), ("1990 - 2020", ""), ("(0)30 12345678", "030 12345678"), ("0000 123456", "")]),
    (contacts.site_phone, [("01.01.2025. +49 211 7692150", "+49 211 7692150"), ("09.012.2020", "")]),
    (contacts.site_email, [("logo@2x.png", ""), ("Mail: Max@a.example.", "max@a.example")]),
    (contacts.legal_form, [("Muster GmbH & Co. KG", "GmbH & Co. KG"), ("Muster gmbh", "gmbh"), ("nichts", "")]),
    (lambda c: contacts.company_identity(c)["legal_name"], [("Impressum Muster Handel GmbH Musterweg 1", "Muster Handel GmbH"), ("Google Ireland GmbH", ""), ("250 g Tee GmbH", ""), ("", "")]),
    (lambda c: contacts.decision_maker(c)["name"], [("Geschäftsführer: Erika Muster Telefon 030", "Erika Muster"), ("Inhaber: Max", ""), ("run by Jane Doe. The company sells", "Jane Doe"), (None, "")]),
    (contacts.address, [("Beispielstraße 12a 12345 Musterstadt Telefon 030", "Beispielstraße 12a, 12345 Musterstadt"), ("kein Ort", "")]),
    (contacts.registration_id, [("IK-Nr. 123456789", "123456789"), ("Institutionskennzeichen der Firma lautet 987654321", "987654321"), ("HRB 123456789", ""), (None, "")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_expression(spark, case):
    expression, pairs = CASES[case]
    assert run(spark, expression, [a for a, _ in pairs]) == [b for _, b in pairs]
