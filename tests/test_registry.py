import threading

import pytest
from pyspark.sql import functions as F

from tamarack.plans import gates, runs
from tamarack.sources import commits, tables


def test_latest_state_is_the_one_of_the_greatest_ordinal(spark):
    log = [("a", 1, 1, "started", 0), ("a", 2, 2, "finished", 5), ("a", 2, 3, "failed", 9), ("b", None, 4, "started", 1), ("c", 7, 5, "started", 0), ("c", 7, 6, "finished", None), (None, 3, 7, "started", 2)]
    df = spark.createDataFrame(log[::-1], "run_id string, ts long, ord long, status string, created long")
    got = {r.run_id: tuple(r) for r in gates.run_states(df).collect()}
    assert got == {"a": ("a", 1, 2, "failed", 9), "b": ("b", None, None, "started", 1), "c": ("c", 7, 7, "finished", None), None: (None, 3, 3, "started", 2)}
    assert gates.run_states(df.limit(0)).count() == 0


def leads(spark, *domains):
    return spark.createDataFrame([(i, d, f"name {i}") for i, d in enumerate(domains)], "ord long, domain_key string, company_name string")


def union(spark, rows):
    return lambda stored: rows if stored is None else stored.unionByName(rows)


def test_a_number_is_given_out_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commits.latest(spark, folder) is None and commits.commit(spark, folder, 1, {"who": "a"})
    assert not commits.commit(spark, folder, 1, {"who": "b"})
    assert commits.latest(spark, folder) == (1, {"who": "a"})
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if commits.commit(spark, folder, 2, {"who": k}) else None) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and commits.entry(spark, folder, 2) == {"who": won[0]}
    assert [p.name for p in (tmp_path / "log" / "_log").iterdir() if p.name[0] == "."] == []


def test_interleaved_writers_lose_no_row(spark, tmp_path):
    folder = str(tmp_path / "m")
    tables.write_master(spark.range(2), folder)
    seen = []

    def slow(stored):
        seen.append(sorted(r.id for r in stored.collect()))
        if len(seen) == 1:  # another writer comes between reading and committing
            tables.update_master(spark, folder, union(spark, spark.range(10, 12)))
        return stored.unionByName(spark.range(20, 22))

    assert tables.update_master(spark, folder, slow) == 3
    assert seen == [[0, 1], [0, 1, 10, 11]]
    assert sorted(r.id for r in tables.read_master(spark, folder).collect()) == [0, 1, 10, 11, 20, 21]
    assert tables.read_master(spark, folder, 1).count() == 2
    with pytest.raises(commits.Conflict):
        tables.write_master(spark.range(1), folder, made_from=2)
    tables.write_master(spark.range(5), folder, made_from=3)
    assert tables.read_master(spark, folder).count() == 5
    assert tables.forget_versions(spark, folder, keep=1) == [1, 2, 3] and tables.current_version(spark, folder) == 4


def test_many_writers_at_once(spark, tmp_path):
    folder = str(tmp_path / "m")
    threads = [threading.Thread(target=tables.update_master, args=(spark, folder, union(spark, spark.range(10 * k, 10 * k + 3)))) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tables.current_version(spark, folder) == 5 and tables.read_master(spark, folder).count() == 15


def test_a_repeated_batch_writes_no_version(spark, tmp_path):
    folder = str(tmp_path / "m")
    for batch in (0, 1, 1, 0):
        tables.update_master(spark, folder, union(spark, spark.range(batch, batch + 1)), "w", batch)
    tables.update_master(spark, folder, union(spark, spark.range(9, 10)), "other", 0)
    assert tables.current_version(spark, folder) == 3
    assert sorted(r.id for r in tables.read_master(spark, folder).collect()) == [0, 1, 9]


def test_runs_with_counts_and_failures(spark, tmp_path):
    folder, read = str(tmp_path), spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    first = leads(spark, "a.example", "b.example", "a.example", "", None).mapInArrow(tally, "ord long, domain_key string, company_name string")
    assert runs.import_leads(spark, folder, first, "one", "t1", 0, ["in.csv"]) == 1
    assert read.value == 5  # the rows are read once
    runs.import_leads(spark, folder, leads(spark, "b.example", "c.example"), "two", "t2", 0)
    runs.import_leads(spark, folder, leads(spark, "z.example"), "two", "t3", 0)  # committed before
    with pytest.raises(Exception, match="broken row"):
        runs.import_leads(spark, folder, leads(spark, "d.example").withColumn("company_name", F.raise_error(F.lit("broken row")).cast("string")), "three", "t4")
    with pytest.raises(KeyboardInterrupt):
        with runs.Run(spark, f"{folder}/runs", "verification"):
            raise KeyboardInterrupt
    got = {(r.notes, r.run_type, r.records_read, r.status): r for r in runs.registry(spark, f"{folder}/runs").collect()}
    counts = {k[:1] + k[3:]: tuple(r[c] for c in runs.COUNTS) for k, r in got.items() if k[1] == "scrape_import" and (k[0], k[2]) != ("two", 0)}
    assert counts == {("one", "done"): (5, 2, 2, 1, 2), ("two", "done"): (2, 3, 1, 1, 0), ("three", "failed"): (0, 0, 0, 0, 0)}
    assert tuple(got[("two", "scrape_import", 0, "done")][c] for c in runs.COUNTS) == (0,) * 5
    assert "broken row" in got[("three", "scrape_import", 0, "failed")].error and got[("", "verification", 0, "failed")].error == "KeyboardInterrupt"
    assert got[("one", "scrape_import", 5, "done")].input_paths == "in.csv" and got[("one", "scrape_import", 5, "done")].finished_at != ""
    assert [r.ord for r in runs.registry_log(spark, f"{folder}/runs").orderBy("ord").collect()] == list(range(1, 11))
    assert {r.domain_key for r in tables.read_master(spark, f"{folder}/master").collect()} == {"a.example", "b.example", "c.example"}
    assert runs.registry(spark, f"{folder}/none").count() == 0
