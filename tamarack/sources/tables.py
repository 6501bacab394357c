"""Reading and writing lead tables: delimited files, versioned masters, buckets, exports."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import clean_text, filled
from . import commits

_own: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key over the session's cores, for costly work on a small file that one task would read."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none and runs in one process: a temporary one, removed when the process ends.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tamarack-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def cut(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from there.

    With columns in ``folders`` the rows of each of their values lie in a folder, so that readers of one value read nothing else.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that no later step reads."""
    for df in frames:
        commits.delete(df.sparkSession, df._written_to)


def sniff_delimiter(header: str, fallback: str = ";") -> str:
    """The delimiter that splits a header line into most columns."""
    best = max((",", ";", "\t"), key=header.count)
    return best if header.count(best) else fallback


def read_leads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Delimited files of any of three delimiters, each told by its header; all columns are text.

    Columns of all files are united. ``source_name`` is the file's stem and ``ord`` the row's place: file, then offset in it.
    """
    headers = spark.read.text(paths, wholetext=False).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    first = headers.where(F.col("at") == 0).groupBy("path").agg(F.min_by("value", "id").alias("header")).collect()  # one row per file
    by_path = {r.path: (sniff_delimiter(r.header.lstrip("\ufeff")), r.header.lstrip("\ufeff")) for r in first}
    number = F.create_map(*[F.lit(x) for i, p in enumerate(sorted(by_path)) for x in (p, i)])
    frames = []
    for delimiter, header in sorted(set(by_path.values())):  # files of one header are read together
        own = sorted(p for p, kind in by_path.items() if kind == (delimiter, header))
        df = spark.read.csv(own, sep=delimiter, header=True, encoding="UTF-8", quote='"', escape='"', multiLine=False)
        df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
        place = F.struct(number[F.col("_metadata.file_path")].alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
        frames.append(df.withColumns({"source_name": F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1), "ord": place}))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def conform(df: DataFrame, columns: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """The canonical columns first, cleaned and with defaults where blank; then all others as they are."""
    defaults = defaults or {}

    def cell(c: str) -> Column:
        base = filled(c) if c in df.columns else F.lit(None).cast("string")
        return F.coalesce(base, F.lit(defaults.get(c, ""))).alias(c)

    return df.select(*map(cell, columns), *[c for c in df.columns if c not in columns])


def update_master(spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], writer: str = "", batch: int | None = None, attempts: int = 20) -> int:
    """Commit ``change`` of the current table (None: there is none yet) as the next version; returns the version.

    Versions are numbered commits that exist once. A writer whose number was taken by another one reads the table anew and changes
    that, so of writers side by side none loses rows. ``batch`` numbers a writer's batches upwards: one that was committed before
    isn't made again, whoever retries it. Readers see the table of a commit as a whole; what a broken-off write left is never read.
    """
    for _ in range(attempts):
        now = commits.latest(spark, folder)
        version, known = now if now else (0, {"batches": {}})
        if batch is not None and known["batches"].get(writer, -1) >= batch:
            return version
        path = f"v={version + 1}-{uuid.uuid4().hex}"
        change(spark.read.parquet(f"{folder}/{known['path']}") if now else None).write.mode("errorifexists").parquet(f"{folder}/{path}")
        batches = known["batches"] | ({} if batch is None else {writer: batch})
        if commits.commit(spark, folder, version + 1, {"version": version + 1, "path": path, "batches": batches}):
            return version + 1
        commits.delete(spark, f"{folder}/{path}")
    raise commits.Conflict(f"{attempts} other writers came first in {folder}")


def write_master(df: DataFrame, folder: str, made_from: int | None = None) -> str:
    """Replace the table as a whole; readers see the old or the new one. Returns the new one's path.

    ``made_from`` is the version that ``df`` was made from (0: there was none): a Conflict is raised if another has come since.
    Without it the last writer's table stands. The version being read is never overwritten.
    """
    spark = df.sparkSession

    def checked(_):
        if made_from is not None and made_from != (current_version(spark, folder) or 0):
            raise commits.Conflict(f"{folder} is past version {made_from}")
        return df

    version = update_master(spark, folder, checked, attempts=20 if made_from is None else 1)
    return f"{folder}/{commits.entry(spark, folder, version)['path']}"


def current_version(spark: SparkSession, folder: str) -> int | None:
    known = commits.numbers(spark, folder)
    return known[-1] if known else None


def read_master(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The table of the current version, or of an earlier one that is still there."""
    version = version or current_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/{commits.entry(spark, folder, version)['path']}")


def forget_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete the tables of all but the last ``keep`` versions; their log entries stay, so that no number is given out twice."""
    old = commits.numbers(spark, folder)[: -keep or None]
    for version in old:
        commits.delete(spark, f"{folder}/{commits.entry(spark, folder, version)['path']}")
    return old


def write_buckets(df: DataFrame, folder: str, bucket: str, run_id: str) -> str:
    """Write a run's rows in a folder for each value of ``bucket``, then make them the current state; returns their path.

    One writing serves both, the run's own copy and the current state: the latter is the commit with the greatest number, so readers see the state before or
    after, never some buckets of each. A run that is written again has a copy of its own, and its last one counts.
    """
    spark = df.sparkSession
    path = f"run_id={run_id}/{uuid.uuid4().hex}"
    df.write.partitionBy(bucket).parquet(f"{folder}/{path}")
    commits.append(spark, folder, lambda number: {"version": number, "run_id": run_id, "bucket": bucket, "path": path, "schema": df.schema.json()})
    return f"{folder}/{path}"


def read_buckets(spark: SparkSession, folder: str, bucket: str | None = None, run_id: str | None = None) -> DataFrame | None:
    """The current state, or a run's copy; all of it, or the rows of one bucket. None if there is none."""
    for number in reversed(commits.numbers(spark, folder)):
        known = commits.entry(spark, folder, number)
        if run_id in (None, known["run_id"]):
            rows = spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{folder}/{known['path']}")
            return rows if bucket is None else rows.where(F.col(known["bucket"]) == bucket)
    return None


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Semicolons, header, fixed order of columns; others are left out, missing ones blank."""
    df.select(*((clean_text(c) if c in df.columns else F.lit("")).alias(c) for c in columns)).write.mode("overwrite").csv(path, sep=";", header=True, escape='"')


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str] | None = None) -> None:
    """Replace the rows of a database table, which is made if there is none; every column is text. The driver's jar is the caller's to supply.

    Tasks load a table ``name``_new side by side; then one transaction deletes the old rows and takes over the new ones. If a task or
    the transaction fails, the old rows stand. A table that exists must have the same columns.
    """
    properties = properties or {}
    text = df.select(*(F.col(c).cast("string") for c in df.columns))
    text.write.jdbc(url, f"{name}_new", mode="overwrite", properties=properties)
    text.limit(0).write.jdbc(url, name, mode="append", properties=properties)
    jvm = df.sparkSession.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            statement.executeUpdate(f"DELETE FROM {name}")
            statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {name}_new")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        statement.executeUpdate(f"DROP TABLE {name}_new")
        connection.commit()
    finally:
        connection.close()
