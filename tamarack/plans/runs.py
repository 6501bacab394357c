"""Runs that keep a registry: start, end or failure with counts that come from the pass that writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert_leads
from ..sources import commits
from ..sources.tables import update_master
from .gates import run_states

# The counts of a registry row.
COUNTS = ["records_read", "records_written", "records_created", "records_updated", "records_skipped"]
ENTRY = "run_id string, ord long, ts string, run_type string, status string, input_paths string, output_paths string, " + ", ".join(f"{c} long" for c in COUNTS) + ", notes string, error string, detail string"


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Run:
    """A run as a context: the registry gets an entry at its start and one at its end, with the error if it failed.

    Entries are numbered commits, so runs side by side lose none and their order is that of the numbers, not of the clock.
    """

    def __init__(self, spark: SparkSession, registry: str, run_type: str, inputs: list[str] = (), notes: str = "", now: Callable[[], str] = utc_now):
        self.spark, self.registry, self.now = spark, registry, now
        self.fixed = {"run_type": run_type, "input_paths": "|".join(inputs)}
        stamp = "".join(ch for ch in now() if ch not in "-:Z")
        self.run_id, self.notes, self.outputs, self.detail = f"{run_type}_{stamp}_{uuid.uuid4().hex[:8]}", notes, [], {}
        self.observation: Observation | None = None

    def _note(self, status: str, **more) -> None:
        base = {"run_id": self.run_id, "ts": self.now(), **self.fixed, "status": status, "output_paths": "|".join(self.outputs), **dict.fromkeys(COUNTS, 0), "notes": self.notes, "error": "", "detail": json.dumps(self.detail)}
        commits.append(self.spark, self.registry, lambda number: base | more | {"ord": number})

    def __enter__(self) -> Run:
        self._note("running")
        return self

    def observe(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df`` with the counts taken while it is written; of several attempts the last one counts.

        To be put right before the write, after the last shuffle: Spark counts the tasks of a job's last stage once, whatever is retried.
        """
        self.observation = Observation()
        return df.observe(self.observation, *(F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counts.items()))

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            message = next((line for line in str(error).splitlines() if line.strip()), "")
            self._note("failed", error=message or kind.__name__)
        else:
            self._note("done", **(self.observation.get if self.observation else {}))


def registry_log(spark: SparkSession, registry: str) -> DataFrame:
    return commits.read_log(spark, registry, ENTRY)


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each run: its latest entry and when it started; a run without an end stands as running."""
    out = run_states(registry_log(spark, folder))
    ended = F.when(F.col("status") == "running", "").otherwise(F.col("ts")).alias("finished_at")
    return out.select("run_id", "run_type", "status", "started_at", ended, "input_paths", "output_paths", *COUNTS, "notes", "error", "detail")


def import_leads(spark: SparkSession, folder: str, incoming: DataFrame, source: str, now: str, batch: int | None = None, inputs: list[str] = (), clock: Callable[[], str] = utc_now) -> int:
    """Upsert rows (domain_key, ord, ...) into the master in ``folder``/master, as a run of ``folder``/runs; returns the version.

    Counts: rows read, rows of the new version written, keys created, rows that met a key (stored, or created by
    an earlier row), rows without a key skipped. One plan reads, counts and writes. A batch committed before changes nothing.
    """
    with Run(spark, f"{folder}/runs", "scrape_import", list(inputs), source, clock) as run:

        def change(stored: DataFrame | None) -> DataFrame:
            empty = spark.createDataFrame([], "domain_key string, lead_id string") if stored is None else stored
            merged = upsert_leads(empty, incoming, source, run.run_id, now, keyless=True)
            keyed, came = F.col("domain_key") != "", F.col("incoming_rows")
            merged = run.observe(
                merged,
                records_read=F.sum(came),
                records_written=F.count_if(keyed),
                records_created=F.count_if(keyed & F.col("is_created")),
                records_updated=F.sum(F.when(keyed, came - F.col("is_created").cast("long"))),
                records_skipped=F.sum(F.when(~keyed, came)),
            )
            return merged.where(keyed).drop("is_created", "is_updated", "incoming_rows")

        version = update_master(spark, f"{folder}/master", change, source, batch)
        run.outputs, run.detail = [f"{folder}/master"], {"version": version}
    return version
