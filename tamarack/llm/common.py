"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_released = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share, or else the one ``setCheckpointDir`` named.

    Where there is none: a temporary folder of this process if Spark runs in this process alone, an error on a cluster.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tamarack-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, every three seconds at most: it waits for the driver's garbage collection."""
    if time.monotonic() - _released[0] < 3:
        return
    _released[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage, survives lost executors, and gives later joins plain scans whose skewed
    partitions adaptive execution can split.
    """
    spark = df.sparkSession
    release(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames that no later step reads."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
        taken.add(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, mod: int = 5) -> Column:
    """crc32 of the id as text, mod 5: 0 marks the held-out rows; a null id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string")), F.lit(mod)), F.lit(1))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``: a bounded sample that doesn't depend on partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(n)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20):
    """Cut a batch so that no slice holds more than ``most`` bytes of ``column`` (one row at least)."""
    sizes = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)
