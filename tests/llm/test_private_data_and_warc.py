import collections
import hashlib
import math
import random
import re

import pytest
import regex
from oracle import assert_same, duck

from tamarack.llm import private_data, queries, warc
from tamarack.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


ODD = ["a@b.c+d@e.f", "+1 (2) 345-678-9012 +49 30 1234567", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é1.2.3.4😀+1 234 567 8901", "1" * 20000, "1 " * 20000, "a" * 50000, "a@" + "b." * 8000 + "c", "\x01a@b.cc\x01 \x02 5.5.5.5", "", None, "x.y@z ..@a.b 1..2.3.4.5"]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab1234567890.@+- ()%é") for _ in range(80)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = private_data.report(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(f"(?:^|,){k}:", want)) for k in PLAIN]
    assert private_data.report(df.limit(0)).count() == 0


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"text number {i} by the harbour Quillon wrote from q@mail.example about things") for i in range(4)]
    rows += [(100 + i, f"the harbour about things wrote from {i}") for i in range(60)]
    rows += [(500, "Quillon wrote from q@mail.example about"), (500, "Quillon wrote from q@mail.example about"), (501, "Quillon alone is not near it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", __import__("pyspark").sql.functions.char_length("text").cast("long"))
    got = {r.doc_id: r.spans for r in private_data.report(df).collect()}
    text = rows[0][1]
    at = text.index("Quillon")
    assert f"term:{at}:{at + 7}" in got[0] and "email:" in got[0] and got[100] == "" and got[501] == ""
    assert not any(f"term:{text.index(w)}:" in got[0] for w in ("wrote", "from", "about"))
    clean = {r.doc_id: r for r in private_data.sanitise(df).collect()}
    assert "Quillon" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[100].text == rows[4][1]
    assert clean[0].n_chars == len(clean[0].text) and private_data.sanitise(df).count() == len(rows)


def plain_shares(texts, threshold=0.8):
    """(start, end, share) of the term spans of each text by the formula, entity by entity, in plain Python."""
    n, held, words, df = len(texts), [], [], collections.Counter()
    for t in texts:
        found = [x.split(":") for x in plain(t).split(",") if x]
        found = [(k, int(a), int(b)) for k, a, b in found]
        names = {(k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for k, a, b in found}
        held.append((found, names))
        own = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", t)]
        words.append([w for w in own if len(w[2]) >= 3 and regex.search(r"\p{L}", w[2])])
        df.update({w[2] for w in words[-1]})
    df_e, both = collections.Counter(), collections.Counter()
    for (_, names), own in zip(held, words):
        df_e.update(names)
        both.update((e, t) for e in names for t in {w[2] for w in own})
    share = lambda e, t: math.log((both[e, t] * n / df_e[e] + 2) / (df[t] + 2)) / math.log(n / df_e[e])
    out = []
    for (found, names), own in zip(held, words):
        shares = [(a, b, max((share(e, t) for e in names if df_e[e] < n), default=-1)) for a, b, t in own]
        out.append([s for s in shares if s[2] >= threshold and not any(x < s[1] and s[0] < y for _, x, y in found)])
    return out


def plain_terms(texts):
    return [[f"term:{a}:{b}" for a, b, _ in spans] for spans in plain_shares(texts)]


def test_terms_against_brute_force(spark):
    rng = random.Random(11)
    common, rare = [f"word{i}x" for i in range(40)], [f"Rare{i}é" for i in range(60)]
    mails = [f"p{i}@mail.example" for i in range(12)] + ["1.2.3.4", "+1 234 567 8901", "+12345678901", "4111 1111 1111 1111"]
    texts = []
    for i in range(500):
        parts = [rng.choice(common) for _ in range(12)] + [rng.choice(rare) for _ in range(rng.randrange(3))]
        parts += [rng.choice(mails) for _ in range(rng.randrange(3))] if i % 3 == 0 else []
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [texts[0], texts[3], texts[3], "only-here Zed9 p0@mail.example9 abc4111111111111111"]
    texts += [f"many{i} own{i}@far.example" for i in range(20)] + [" ".join(f"own{i}@far.example quux{i}" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in private_data.report(df).collect()}
    want = plain_terms(texts)
    assert sum(map(len, want)) > 50
    assert [got[i] for i in range(len(texts))] == want


def test_many_groups_in_one_text(spark, monkeypatch):
    """A text whose addresses each stand in a text of their own too: rows grow with the text, not with its square."""
    rows = {}
    for k in (100, 400):
        texts = [f"own{i} a{i}@far.example say{i % 5} both{i}" for i in range(k)] + [f"filler text {i}" for i in range(300)]
        texts.append(" ".join(f"own{i if i % 2 else -i} a{i}@far.example" for i in range(k)))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        written = {}

        def keep(frame, name, real=private_data.materialize, written=written):
            out = real(frame, name)
            written[name] = out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(private_data, "materialize", keep)
            got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in private_data.report(df).collect()}
        assert [got[i] for i in range(len(texts))] == plain_terms(texts)
        rows[k] = max(written.values())
    assert rows[400] < 5 * rows[100]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@m{i % 7}.example is" for i in range(20000))
    rows = [(i, f"plain text {i}", "x", -i) for i in range(9)] + [(99, text, "y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash string, id long")
    clean = {r.doc_id: r for r in private_data.sanitise(df).collect()}
    assert clean[99].text == " ".join(["[EMAIL] is"] * 20000) and (clean[99]._hash, clean[99].id) == ("y", 5)
    assert [(clean[i].text, clean[i]._hash, clean[i].id) for i in range(9)] == [(f"plain text {i}", "x", -i) for i in range(9)]


def test_terms_anywhere_in_the_documents_of_an_entity(spark):
    filler = "the harbour about things wrote from " * 8
    text = f"Quillon began. {filler} Mail q@mail.example {filler} and quillon ended"
    rows = [(i, text) for i in range(4)] + [(100 + i, filler) for i in range(60)] + [(500, "Quillon alone")]
    got = {r.doc_id: r.spans for r in private_data.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = text.index("quillon")
    assert {"term:0:7", f"term:{last}:{last + 7}"} <= set(got[0].split(",")) and got[500] == "" and got[100] == ""
    assert not any(f"term:{m.start()}:" in got[0] for m in re.finditer("harbour|things|wrote", text))


def test_terms_of_an_entity_met_once(spark):
    rows = [(i, "the harbour about things wrote from") for i in range(400)]
    rows += [(900, "the harbour wrote to z@mail.example about Zorblax from things"), (901, "Quorbit wrote from the harbour")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private_data.report(df).collect()}
    at = rows[400][1].index("Zorblax")
    assert got[900].split(",")[1:] == [f"term:{at}:{at + 7}"] and got[901] == "" and got[0] == ""
    clean = {r.doc_id: r.text for r in private_data.sanitise(df).collect()}
    assert clean[900] == "the harbour wrote to [EMAIL] about [TERM] from things"


def test_warc_against_sql(spark):
    assert_same(queries.op7_warc(spark, SF), duck(SF), queries.ORACLE_SQL["op7_warc"])


@pytest.mark.parametrize(("url", "key"), [("http://User@Blog.Example.com:80/a/b?x=1#f", "com,example,blog)/a/b?x=1"), ("https://example.org", "org,example)/"), (None, ")/"), ("https://münchen.example/ü", "example,m%C3%BCnchen)/%C3%BC")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_warc_edges(spark):
    rows = [(3, "https://a.example/x", "same"), (1, "https://b.example/", "same"), (2, None, None), (4, "https://a.example/x", ""), (5, "https://a.example/x", "ü" * 100_000), (1, "https://b.example/", "same"), (None, "https://c.example/", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = fresh_path(spark, "warc")
    captures = warc.write(df, folder)
    parts = warc.build_index(captures, folder, block=2)
    got = warc.read(warc.locate(df, parts), with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[1]] == ["response"] * 2 and by[3][0].refers_to == 1 and by[None][0].refers_to == 1
    assert by[2][0].record_type == "response" and by[4][0].refers_to == 2 and by[4][0].payload_bytes == 0
    assert by[5][0].payload.decode() == "ü" * 100_000 and by[3][0].payload_bytes == 4
    found = warc.locate(spark.createDataFrame([("https://nowhere.example/", 1)], "url string, page_id long"), parts)
    assert found.count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_find_reads_only_the_pairs_blocks(spark):
    folder = fresh_path(spark, "warc")
    captures = spark.createDataFrame([("k", i, "f", i, 1) for i in range(1000)] + [("k", None, "f", 5000, 1), ("k", 500, "f", 5001, 1), ("a", 3, "f", 7, 1), ("z", None, "f", 8, 1)], warc.CAPTURE)
    index = warc.Index([tuple(r) for r in warc.build_index(captures, folder, block=10).collect()])
    read, block = [], index.block
    index.block = lambda *a: read.append(a) or block(*a)
    assert [c[2] for c in index.find("k", 500)] == [500, 5001] and len(read) <= 2
    assert [c[2] for c in index.find("k", None)] == [5000] and [c[2] for c in index.find("z", None)] == [8] and [c[2] for c in index.find("a", 3)] == [7]
    assert list(index.find("k", 1000)) == list(index.find("b", 1)) == list(index.find("zz", 1)) == []
    assert all([c[2] for c in index.find("k", i)] == [i] for i in range(1000) if i != 500)
