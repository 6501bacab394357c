"""The composed run: broken off after each step, it goes on where it stopped and ends with the same rows."""

import pytest

from tamarack.plans import pipeline


def inputs(spark, path):
    results = [(i, f"https://s{i}.example.de/", f"Shop {i}", "") for i in range(8)] + [(8, "https://s0.example.de/x", "", "")]
    care = "Pflegebox Pflegehilfsmittel zum Verbrauch Pflegekasse Pflegegrad Antrag stellen IK: 123456789 Impressum Nordlicht GmbH Geschäftsführer: Erika Muster"
    pages = [(f"s{i}.example.de", "/", f"https://s{i}.example.de/", 200, 100, care if i % 2 else "nichts", 1) for i in range(8)]
    hits = [(f"lead_{i}", 1, 1, "Impressum", f"https://s{i}.example.de/impressum", "") for i in range(8)]
    for name, rows, schema in (
        ("results", results, "ord long, url string, title string, email string"),
        ("pages", pages, "domain string, path string, url string, status int, elapsed_ms int, html string, fetch_order int"),
        ("serper", hits, "lead_id string, qno int, position int, title string, link string, snippet string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")
    return lambda: {n: spark.read.parquet(f"{path}/{n}") for n in ("results", "pages", "serper")}


def run(spark, folder, tables, **more):
    return pipeline.run_pipeline(spark, folder, tables["results"], tables["pages"], {"serper": tables["serper"]}, "2026-01-01T00:00:00Z", limits={"serper": 5}, **more)


def rows_of(result):
    return sorted(map(repr, (r.asDict() for r in result["handoff"].frame.collect())))


STEPS = ["scrape", "verification", "verified_master", "queue", "waterfall", "master", "handoff"]


def test_a_broken_off_run_goes_on(spark, tmp_path, monkeypatch):
    tables = inputs(spark, str(tmp_path / "in"))
    whole, report = run(spark, str(tmp_path / "whole"), tables())
    assert report == [(s, "done") for s in STEPS]
    assert whole["master"].frame.count() == 8 and whole["queue"].frame.count() == 4
    master = {r.domain_key: r for r in whole["master"].frame.collect()}
    assert master["s1.example.de"].verification_status == "done" and master["s0.example.de"].lead_grade == "Reject"
    folder = str(tmp_path / "broken")
    for name, k in (("verify_step", 1), ("waterfall_step", 4), ("handoff_step", 6)):  # each run gets further and breaks off in a later step
        with monkeypatch.context() as m:
            m.setattr(pipeline, name, lambda *a, **o: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                run(spark, folder, tables())
            done = {p.name.split("-")[0]: p.stat().st_mtime_ns for p in (tmp_path / "broken" / "_manifest").glob("*.json")}
            assert sorted(done) == sorted(STEPS[:k]) and len(list((tmp_path / "broken").glob("[a-z]*"))) == k
    again, report = run(spark, folder, tables())
    assert report == [(s, "found") for s in STEPS[:-1]] + [("handoff", "done")]
    assert rows_of(again) == rows_of(whole)
    # another option makes anew only what depends on it
    assert run(spark, folder, tables(), batch="b2")[1] == [(s, "found") for s in STEPS[:-1]] + [("handoff", "done")]


def test_fingerprints(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    read = lambda: spark.read.parquet(str(tmp_path / "a"))
    first = pipeline.fingerprint(read())
    assert first == pipeline.fingerprint(read()) != pipeline.fingerprint(read().where("id > 2"))
    spark.range(1).write.mode("append").parquet(str(tmp_path / "a"))
    assert first != pipeline.fingerprint(read())
    assert pipeline.fingerprint(spark.createDataFrame([(1, "x")], "a int, b string")) != pipeline.fingerprint(spark.createDataFrame([(1, "y")], "a int, b string"))
