"""The whole run from search results to the hand-off queue, in steps that a broken-off run finds again.

A step's result is a table in the run folder and a manifest entry named by the step and a fingerprint: of the step's name and options and of
its inputs' fingerprints. The entry is put there after the table is whole. A step whose entry exists isn't
made again, so a run that broke off goes on where it stopped, and one with another input or option makes anew only what depends on it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify
from ..operators.merge import upsert_leads
from ..sources import commits
from . import patches
from .gates import final_gate, handoff_queue
from .queue import build_queue
from .verification import verify
from .waterfall import run_waterfall


@dataclass
class Result:
    name: str
    frame: DataFrame
    fingerprint: str


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """Of a table's plan and of its files' names, sizes and times; of a table without files, of its rows."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed().canonicalized().toString()
    files = []
    for name in sorted(df.inputFiles()):
        path, fs = commits._path(spark, name)
        status = fs.getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    if files:
        return _digest(plan, files)
    rows = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.to_json(F.struct("*")))).alias("x"), F.sum(F.xxhash64(F.to_json(F.struct("*"))) % 1_000_003).alias("s")).first()
    return _digest(df.schema.json(), tuple(rows))


@dataclass
class Steps:
    """The steps of a run below ``folder``; ``report`` says of each whether it was done now or found."""

    spark: SparkSession
    folder: str
    report: list[tuple[str, str]] = field(default_factory=list)

    def source(self, name: str, df: DataFrame) -> Result:
        return Result(name, df, fingerprint(df))

    def step(self, name: str, build: Callable[..., DataFrame], *inputs: Result, **options) -> Result:
        """The table that ``build`` makes of the inputs' tables and the options, now or in an earlier run."""
        key = _digest(name, options, [i.fingerprint for i in inputs])
        entry = f"{self.folder}/_manifest/{name}-{key}.json"
        known = self._known(entry)
        if known is None:
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            build(*(i.frame for i in inputs), **options).write.parquet(path)
            value = {"step": name, "path": path, "inputs": {i.name: i.fingerprint for i in inputs}, "options": options}
            if not commits.put_if_absent(self.spark, entry, json.dumps(value, default=str)):  # the same run beside this one came first
                commits.delete(self.spark, path)
            known = self._known(entry)
            self.report.append((name, "done"))
        else:
            self.report.append((name, "found"))
        return Result(name, self.spark.read.parquet(known["path"]), key)

    def _known(self, entry: str) -> dict | None:
        path, fs = commits._path(self.spark, entry)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.monotonically_increasing_id())


def scrape_step(results: DataFrame, source: str, now: str) -> DataFrame:
    """Search results as the master's first leads."""
    rows = patches.scrape_rows(results)
    empty = rows.select(F.lit("").alias("domain_key"), F.lit("").alias("lead_id")).limit(0)
    return upsert_leads(empty, rows, source, source, now).drop("is_created", "is_updated", "incoming_rows")


def verify_step(master: DataFrame, pages: DataFrame, now: str, niche: str, parameters: dict) -> DataFrame:
    leads = master.select(F.col("domain_key").alias("domain"), "url", *[c for c in ("company_name", "email", "phone", "country_hint") if c in master.columns])
    return _numbered(verify(leads, pages, now, niche, **parameters))


def verified_step(master: DataFrame, checks: DataFrame, source: str, now: str) -> DataFrame:
    rows = patches.scrape_rows(checks.select("ord", "domain", "company_name"))
    return patches.import_and_merge(master, rows, patches.verification_patch(checks, now), source, source, now)[0]


def queue_step(checks: DataFrame, now: str, min_score: int, enabled: dict) -> DataFrame:
    bucket = classify.bucket(F.col("lead_type"), F.col("vhd_fit_score").cast("int"), F.col("next_action"), min_score)
    rows = checks.withColumn("_bucket", bucket)
    part = lambda name: rows.where(F.col("_bucket") == name).drop("_bucket")
    return build_queue(part("verified"), part("review"), now, enabled=enabled)


def waterfall_step(queue: DataFrame, *answers: DataFrame, providers: list[str], limits: dict, rounds: int) -> DataFrame:
    return final_gate(run_waterfall(queue, dict(zip(providers, answers)), limits, rounds=rounds)[0])


def enriched_step(master: DataFrame, enriched: DataFrame, source: str, now: str) -> DataFrame:
    rows = patches.scrape_rows(enriched.select("ord", "domain", "company_name"))
    return patches.import_and_merge(master, rows, patches.enrichment_patch(enriched, now), source, source, now)[0]


def handoff_step(master: DataFrame, batch: str, now: str) -> DataFrame:
    return handoff_queue(master, batch, now)


def run_pipeline(
    spark: SparkSession, folder: str, results: DataFrame, pages: DataFrame, answers: dict[str, DataFrame], now: str, niche: str = "pflegebox", min_score: int = 50, limits: dict[str, int] | None = None, rounds: int = 2, batch: str = "b1", parameters: dict | None = None
) -> tuple[dict[str, Result], list[tuple[str, str]]]:
    """Search results (ord, domain or url, ...), fetched pages and the providers' archived answers to master, queue and hand-off.

    ``now`` is the run's own time and one of its options: a run that goes on takes the same. Returns the steps' results by name and the report.
    """
    steps = Steps(spark, folder)
    found, fetched = steps.source("results", results), steps.source("pages", pages)
    served = [steps.source(f"answers_{p}", df) for p, df in sorted(answers.items())]
    out = [
        scraped := steps.step("scrape", scrape_step, found, source="scrape", now=now),
        checks := steps.step("verification", verify_step, scraped, fetched, now=now, niche=niche, parameters=parameters or {}),
        verified := steps.step("verified_master", verified_step, scraped, checks, source="verification", now=now),
        waiting := steps.step("queue", queue_step, checks, now=now, min_score=min_score, enabled=dict.fromkeys(sorted(answers), True)),
        enriched := steps.step("waterfall", waterfall_step, waiting, *served, providers=sorted(answers), limits=limits or {}, rounds=rounds),
        master := steps.step("master", enriched_step, verified, enriched, source="enrichment", now=now),
        steps.step("handoff", handoff_step, master, batch=batch, now=now),
    ]
    return {r.name: r for r in out}, steps.report
