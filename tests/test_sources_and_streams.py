import pytest
from pyspark.sql import functions as F

from tamarack.sources import tables
from tamarack.streaming import streams


def test_reading_files_of_several_shapes(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿domain,company_name\na.example,A\nb.example,\"B, b\"\n", encoding="utf-8")
    (tmp_path / "two.csv").write_text("url;shop_name\nhttps://c.example;C\n", encoding="utf-8")
    df = tables.read_leads(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    rows = df.orderBy("ord").collect()
    assert [r.source_name for r in rows] == ["one", "one", "two"]
    assert [r.company_name for r in rows] == ["A", "B, b", None]
    assert rows[2].url == "https://c.example"
    conformed = tables.conform(df.drop("ord"), ["domain", "status"], {"status": "new"})
    assert conformed.columns[:2] == ["domain", "status"] and {r.status for r in conformed.collect()} == {"new"}


def test_master_versions(spark, tmp_path):
    folder = str(tmp_path / "master")
    assert tables.read_master(spark, folder) is None
    tables.write_master(spark.range(3), folder)
    tables.write_master(tables.read_master(spark, folder).where("id > 0"), folder)
    assert tables.read_master(spark, folder).count() == 2 and tables.current_version(spark, folder) == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    tables.export_csv(df, str(tmp_path / "c"), ["v", "missing", "k"])
    back = spark.read.csv(str(tmp_path / "c"), sep=";", header=True)
    assert back.columns == ["v", "missing", "k"] and back.count() == 2
    tables.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_buckets_switch_as_a_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "b")
    assert tables.read_buckets(spark, folder) is None
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    one = spark.createDataFrame([("a", "x"), ("b", None), (None, "n")], "k string, v string")
    two = spark.createDataFrame([("a", "y"), ("c", "z")], "k string, v string")
    tables.write_buckets(one, folder, "k", "r1")
    held = tables.read_buckets(spark, folder)
    seen, real = [], tables.commits.commit
    key = lambda df: sorted(map(repr, df.collect()))

    def watched(*a):
        seen.append(key(tables.read_buckets(spark, folder)))  # the new buckets are written, but not yet the state
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(tables.commits, "commit", watched)
        tables.write_buckets(two, folder, "k", "r2")
    assert seen == [key(held)] and key(held) == key(tables.read_buckets(spark, folder, run_id="r1"))
    assert rows(tables.read_buckets(spark, folder)) == rows(two) == rows(tables.read_buckets(spark, folder, run_id="r2"))
    assert rows(tables.read_buckets(spark, folder, "c")) == [("c", "z")] and tables.read_buckets(spark, folder, "b").count() == 0
    tables.write_buckets(two.where("k = 'a'"), folder, "k", "r1")  # a run that is written again
    assert rows(tables.read_buckets(spark, folder)) == rows(tables.read_buckets(spark, folder, run_id="r1")) == [("a", "y")]
    assert tables.read_buckets(spark, folder, run_id="none") is None


def test_database_export_is_all_or_nothing(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = lambda: sorted((r.K, r.V) for r in spark.read.jdbc(url, "leads").collect())
    frame = lambda data: spark.createDataFrame(data, "K int, V string").repartition(3)
    tables.export_jdbc(frame([(1, "a"), (2, None)]), url, "leads")
    assert rows() == [("1", "a"), ("2", None)]
    tables.export_jdbc(frame([(k, "b" * k) for k in range(50)]), url, "leads")
    assert len(rows()) == 50 and ("49", "b" * 49) in rows()
    broken = frame([(1, "x"), (2, "bad")]).withColumn("V", F.when(F.col("V") == "bad", F.raise_error(F.lit("lost"))).otherwise(F.col("V")))
    with pytest.raises(Exception, match="lost"):
        tables.export_jdbc(broken, url, "leads")
    with pytest.raises(Exception):
        tables.export_jdbc(frame([(1, "x")]).withColumn("MORE", F.lit("y")), url, "leads")
    assert len(rows()) == 50
    tables.export_jdbc(frame([]), url, "leads")
    assert rows() == []


def test_streamed_upsert_equals_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.example", "A"), (2, "b.example", "")], "ord long, domain_key string, company_name string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], "domain_key string, lead_id string, company_name string")
    for _ in range(2):
        q = streams.stream_upsert(stream, str(tmp_path / "master"), "s", str(tmp_path / "ck"), lambda n: f"t{n}", empty)
        q.awaitTermination()
    assert {r.domain_key for r in tables.read_master(spark, str(tmp_path / "master")).collect()} == {"a.example", "b.example"}


def test_streamed_counts_and_cooldown(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))

    def rows(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = rows(streams.stream_daily_counts(stream, "event_type"), "complete", "daily")
    want = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("used"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    seen = rows(streams.stream_cooldown(stream, ["user_id"], 14), "append", "cooled")
    assert seen.select("user_id").distinct().count() == batch.select("user_id").distinct().count()


def test_a_write_that_broke_off_is_no_hindrance(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "master")
    tables.write_master(spark.range(3), folder)
    with monkeypatch.context() as m:
        m.setattr(tables.commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):  # after the table, before the commit
            tables.write_master(spark.range(5), folder)
    assert tables.read_master(spark, folder).count() == 3
    tables.write_master(spark.range(7), folder)
    assert tables.read_master(spark, folder).count() == 7 and tables.current_version(spark, folder) == 2


def test_streamed_upsert_beside_a_batch_import(spark, tmp_path, monkeypatch):
    """A batch import commits while a streamed batch is being merged, and a streamed batch comes again after its commit."""
    folder, real = str(tmp_path / "master"), tables.commits.commit
    rows = spark.createDataFrame([(1, "a.example", "A")], "ord long, domain_key string, company_name string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], "domain_key string, lead_id string, company_name string")
    came = []

    def late(s, where, number, value):
        if not came:
            came.append(number)
            other = streams.upsert_leads(empty, rows.withColumn("domain_key", F.lit("b.example")), "list", "r", "t")
            tables.update_master(s, folder, lambda stored: other.drop("is_created", "is_updated", "incoming_rows"))
        return real(s, where, number, value)

    with monkeypatch.context() as m:
        m.setattr(tables.commits, "commit", late)
        streams.stream_upsert(stream, folder, "s", str(tmp_path / "ck"), str, empty).awaitTermination()
    assert {r.domain_key for r in tables.read_master(spark, folder).collect()} == {"a.example", "b.example"}
    (tmp_path / "ck" / "commits" / "0").unlink()  # as if the driver was lost after the master's commit
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    streams.stream_upsert(stream, folder, "s", str(tmp_path / "ck"), str, empty).awaitTermination()
    assert tables.current_version(spark, folder) == 2


def test_streamed_cooldown_with_reasons_over_a_restart(spark, tmp_path):
    """Checks in files by time, one late file and a restart between: each row's reason equals that of a fold over the rows as they came."""
    import os
    from datetime import timedelta

    rows = [(r.user_id % 7, r.event_type, r.ts) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").collect()]
    size = -(-len(rows) // 4)
    files = [rows[k * size : (k + 1) * size] for k in range(4)]
    late = files[2][: size // 2]
    files = [files[0], files[1], files[2][size // 2 :], late, files[3]]
    source = tmp_path / "checks"
    os.makedirs(source)

    def add(k):
        frame = spark.createDataFrame(files[k], "user_id long, event_type string, ts timestamp").toPandas()
        frame.to_parquet(source / f"{k}.parquet", coerce_timestamps="us")
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))

    def go():
        stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
        out = streams.stream_check_states(stream, ["user_id", "event_type"], 3, lateness="60 days")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    add(0), add(1)
    go()
    add(2), add(3), add(4)
    go()
    want, last = [], {}
    for part in files:
        for user, kind, ts in sorted(part, key=lambda r: r[2]):
            known = last.get((user, kind))
            skipped = known is not None and known > ts - timedelta(days=3)
            want.append((user, kind, ts, known, "domain_cooldown" if skipped else ""))
            if not skipped:
                last[user, kind] = ts
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert 0 < sum(r[4] == "" for r in got) < len(got) and any(r[3] is not None and r[3] > r[2] for r in got)
