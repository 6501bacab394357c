"""Folds against small sequential models on random rows."""

import random

from pyspark.sql import functions as F

from tamarack.operators import budget, merge


def test_dedupe_equals_the_sequential_fold(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a.example", "b.example", "c.example"]), str(rng.randrange(5)), rng.choice(["", "x", "y"]), rng.choice(["", "p|q", "Q,r"]), rng.choice(["", "n"])) for i in range(60)]
    names = ["ord", "domain", "vhd_fit_score", "company_name", "signals", "notes"]
    want = {}
    for r in rows:
        row = dict(zip(names, r))
        old = want.get(row["domain"])
        if old is None:
            want[row["domain"]] = row
            continue
        better = row if int(row["vhd_fit_score"]) > int(old["vhd_fit_score"]) else old
        other = old if better is row else row
        merged = {k: better[k] if better[k] not in ("", None) else other[k] for k in names}
        tokens = [t.strip().lower() for v in (old["signals"], row["signals"]) for t in v.replace(",", "|").split("|") if t.strip()]
        merged["signals"] = "|".join(dict.fromkeys(tokens))
        merged["notes"] = " | ".join(n for n in (old["notes"], row["notes"]) if n)
        want[row["domain"]] = merged
    df = spark.createDataFrame(rows, "ord long, domain string, vhd_fit_score string, company_name string, signals string, notes string")
    got = {r.domain: r for r in merge.dedupe_leads(df).collect()}
    for d, w in want.items():
        assert [got[d][k] or "" for k in names[2:]] == [w[k] for k in names[2:]]


def test_dedupe_of_a_hot_domain_sends_only_its_scores(spark):
    """Half the rows are of one domain: what is shuffled for it are its distinct scores and tokens, and notes range by range."""
    n = 40000
    df = spark.range(n).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "hot.example").otherwise(F.concat(F.lit("d"), F.col("id") % 997, F.lit(".example"))).alias("domain"),
        (F.col("id") * 7919 % 101).cast("string").alias("vhd_fit_score"), F.when(F.col("id") % 50 == 48, F.concat(F.lit("n"), "id")).otherwise("").alias("company_name"), F.concat(F.lit("t"), F.col("id") % 13).alias("signals"),
    )
    out = merge.dedupe_leads(df.repartition(8))
    rows = out.collect()
    hot = next(r for r in rows if r.domain == "hot.example")
    best = next(i for i in range(0, n, 2) if i * 7919 % 101 == 100)
    raising, top = [], -1
    for i in range(0, best + 1, 2):
        if i * 7919 % 101 > top:
            top, raising = i * 7919 % 101, raising + [i]
    named = [i for i in reversed(raising) if i % 50 == 48] or [48]
    assert (hot.vhd_fit_score, hot.company_name, len(hot.signals.split("|"))) == ("100", f"n{named[0]}", 13)
    assert len(rows) == 1 + len({i % 997 for i in range(1, n, 2)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_key" in plan and "_score" in plan  # the only window is over distinct scores
    joined = merge.joined_notes(df.select("ord", "domain", F.col("signals").alias("notes")), "domain", per_range=1000)
    first = {r.domain: r.notes for r in joined.collect()}["hot.example"]
    assert first == " | ".join(f"t{i % 13}" for i in range(0, n, 2))


def test_upsert_is_idempotent_and_keeps_stored_values(spark):
    stored = spark.createDataFrame([("a.example", "lead_1", "", "kept")], "domain_key string, lead_id string, url string, company_name string")
    rows = spark.createDataFrame([(1, "a.example", "u", "new"), (2, "b.example", "v", ""), (3, "b.example", "", "b"), (4, "", "w", "")], "ord long, domain_key string, url string, company_name string")
    once = merge.upsert_leads(stored, rows, "list", "r1", "t1")
    got = {r.domain_key: r for r in once.collect()}
    assert (got["a.example"].company_name, got["a.example"].url, got["a.example"].lead_id) == ("kept", "u", "lead_1")
    assert (got["b.example"].company_name, got["b.example"].is_created, got["b.example"].duplicate_status) == ("b", True, "canonical")
    counts = merge.upsert_counts(rows, once).first()
    assert (counts.records_read, counts.records_created, counts.records_updated, counts.records_skipped) == (4, 1, 2, 1)
    again = merge.upsert_leads(once.drop("is_created", "is_updated", "incoming_rows"), rows, "list", "r1", "t1")
    assert [c for c in once.columns if once.drop("is_created", "is_updated").exceptAll(again.drop("is_created", "is_updated")).count()] == []
    assert again.where("is_created").count() == 0


def test_evidence_by_confidence_then_order(spark):
    rows = [(1, -1, "old", "0.5"), (1, 1, "low", "0.4"), (1, 2, "high", "90%"), (1, 3, "same", "0.9"), (1, 4, "", "1"), (2, -1, "old", "0.3"), (2, 1, "bare", "")]
    df = spark.createDataFrame(rows, "k int, ord long, value string, confidence string")
    got = {r.k: r.value for r in merge.evidence_winner(df, ["k"]).collect()}
    assert got == {1: "same", 2: "old"}


def test_patches_never_clear(spark):
    leads = spark.createDataFrame([(1, "a", "x", "src", "0.8")], "id int, note string, phone string, phone_source string, phone_confidence string")
    patches = spark.createDataFrame([(1, 1, "", "y", "s2", "0.5"), (1, 2, "b", "", "", ""), (9, 3, "c", "", "", "")], "id int, ord long, note string, phone string, phone_source string, phone_confidence string")
    out = merge.apply_patches(leads, patches, "id", ["note"], ["phone"]).first()
    assert (out.note, out.phone, out.phone_source) == ("b", "x", "src")
    assert merge.unmatched_patches(leads, patches, "id").count() == 1


def test_budgets_for_any_number_of_buckets(spark):
    rng = random.Random(2)
    rows = [(i * 3 + rng.randrange(3), rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, need int")
    for per_range in (1000, 29, 1):
        got = {r.ord: r.spent_before for r in budget.spent_before(df, "need", per_range=per_range).collect()}
        total = 0
        for o, n in sorted(rows):
            assert got[o] == total
            total += n
    granted = sum(r.granted for r in budget.query_budget(df, "need", 100).collect())
    assert granted == 100
    assert budget.row_budget(df, F.col("need") > 1, 10).where("selected").count() == 10


def test_running_sums_over_many_ranges(spark):
    rows = [(i * i * i, (i % 7) / 10) for i in range(300)]  # orders far from evenly spread
    df = spark.createDataFrame(rows, "ord long, cost double").repartition(3)
    got = {r.ord: r.spent_before for r in budget.spent_before(df, "cost", per_range=20).collect()}
    total = 0.0
    for o, c in rows:
        assert abs(got[o] - total) < 1e-9
        total += c
    assert sum(r.runs for r in budget.credit_budget(df, "cost", 10.0).collect()) == sum(1 for o, _ in rows if got[o] < 10.0 - 1e-12)
