"""Streaming forms: upserts as files land, daily counters, and cooldowns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert_leads
from ..sources.tables import update_master


def stream_upsert(files: DataFrame, folder: str, source: str, checkpoint: str, now: Callable[[int], str], empty: DataFrame) -> StreamingQuery:
    """Merge each batch of new rows (domain_key, ord, ...) into the master below ``folder``.

    The batch's number goes into the commit under the checkpoint's path, so a batch that is retried after its commit changes
    nothing, and other writers of the same master lose no rows to this one nor it to them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        def change(stored: DataFrame | None) -> DataFrame:
            merged = upsert_leads(empty if stored is None else stored, batch, source, f"batch-{number}", now(number))
            return merged.drop("is_created", "is_updated", "incoming_rows")

        update_master(batch.sparkSession, folder, change, checkpoint, number)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, at: str) -> DataFrame:
    """Watermarks need a time with a zone: times without one are taken in the session's zone."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def stream_daily_counts(events: DataFrame, key: str, lateness: str = "1 day", at: str = "ts") -> DataFrame:
    """Rows per day and key; days close once the watermark has passed them."""
    counts = timed(events, at).withWatermark(at, lateness).groupBy(F.window(at, "1 day"), key).agg(F.count("*").alias("used"))
    return counts.select(F.to_date(F.col("window.start")).alias("day"), key, "used")


def stream_cooldown(checks: DataFrame, keys: list[str], days: int, at: str = "ts") -> DataFrame:
    """Drop a key that was already seen within ``days``, by event time as far as the watermark allows."""
    return timed(checks, at).withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


def stream_check_states(checks: DataFrame, keys: list[str], days: int, at: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Each wanted check with ``last_checked`` and a ``skip_reason``: ``domain_cooldown`` while the key's last check that ran is less than ``days`` before it, else blank.

    A check that isn't skipped runs and starts the key's cooldown anew; one that comes in late, before a check that has run, is skipped. The last
    check of each key is state, kept over restarts; a timer drops it once the watermark has passed the cooldown's end. Rows behind the watermark are
    left out, as Spark does. Within a batch a key's rows are taken by time; a key's state is one time, whatever the number of its rows.
    """
    window, schema = days * 86_400_000_000, checks.schema
    out = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys) + f", `{at}` timestamp, last_checked timestamp, skip_reason string"

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.sort(np.concatenate([b[at].to_numpy(dtype="datetime64[us]").astype(np.int64) for b in batches]))
        before = np.zeros(len(times), dtype=np.int64)  # 0: none
        runs = np.zeros(len(times), dtype=bool)
        i = 0
        while i < len(times):  # from one check that runs to the next
            end = len(times) if last is None else int(np.searchsorted(times, last + window, side="left"))
            if last is not None and end > i:
                before[i:end], i = last, end
                continue
            before[i], runs[i] = last or 0, True
            last = int(times[i])
            i += 1
        state.update((last,))
        state.setTimeoutTimestamp(max((last + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        known = before != 0
        frame = pd.DataFrame({k: [v] * len(times) for k, v in zip(keys, key)})
        frame[at] = times.astype("datetime64[us]")
        frame["last_checked"] = np.where(known, before, np.iinfo(np.int64).min).astype("datetime64[us]")
        frame["skip_reason"] = np.where(runs, "", "domain_cooldown")
        yield frame

    rows = timed(checks, at).where(F.col(at).isNotNull()).withWatermark(at, lateness)
    return rows.groupBy(*keys).applyInPandasWithState(run, out, "last long", "append", "EventTimeTimeout")
