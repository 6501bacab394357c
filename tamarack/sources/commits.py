"""A log of numbered entries in a folder: each number is written once, by whoever comes first.

An entry is a small JSON file named by its number, put there whole or not at all: written under a name of its own and then
moved to the number's name, which fails if that exists. On local disks the move is a hard link, elsewhere the file system's
rename that doesn't overwrite; both are atomic on POSIX and HDFS. Stores without such a rename can't hold a log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer committed first."""


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def put_if_absent(spark: SparkSession, name: str, text: str) -> bool:
    """Write the file whole, unless it exists."""
    jvm = spark.sparkContext._jvm
    path, fs = _path(spark, name)
    own = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(path.getParent())
    if fs.exists(path):
        return False
    local = (fs.getUri().getScheme() or "file") == "file"
    from py4j.protocol import Py4JJavaError

    try:
        if local:
            place = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0)
            jvm.java.nio.file.Files.write(place(own), bytearray(text.encode()), options)
            jvm.java.nio.file.Files.createLink(place(path), place(own))
        else:
            out = fs.create(own, False)
            out.write(bytearray(text.encode()))
            out.close()
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, path, none)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(own, False)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the entries there are, in order."""
    path, fs = _path(spark, f"{folder}/{LOG}")
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    path, fs = _path(spark, f"{folder}/{LOG}/{number:020d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The last entry and its number; None if there is none."""
    known = numbers(spark, folder)
    return (known[-1], entry(spark, folder, known[-1])) if known else None


def commit(spark: SparkSession, folder: str, number: int, value: dict) -> bool:
    """Make ``value`` the entry of this number; False if it has one."""
    return put_if_absent(spark, f"{folder}/{LOG}/{number:020d}.json", json.dumps(value))


def append(spark: SparkSession, folder: str, value: Callable[[int], dict], attempts: int = 1000) -> int:
    """Commit ``value`` of the next free number, and return that."""
    for _ in range(attempts):
        known = numbers(spark, folder)
        number = known[-1] + 1 if known else 1
        if commit(spark, folder, number, value(number)):
            return number
    raise Conflict(f"no number was free in {folder}")


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All entries as rows."""
    if not numbers(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/{LOG}/[0-9]*.json")
