"""Budgets, cooldowns, counters and query rotation.

Budgets are running sums over a whole table. They are taken in two levels: sums inside ranges of the order that hold about
equally many rows, then prefix sums over these few ranges, so that no task holds the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_ranges(rows: DataFrame, order: str = "ord", per_range: int = 200_000, most: int = 1000) -> tuple[Column, int]:
    """The number of the range that a row's ``order`` lies in, and how many ranges there are.

    The order's quantiles part the rows into ranges of about ``per_range`` rows, however the numbers are spread
    (``most`` ranges at most: of a longer table each holds more).
    """
    parts = max(1, min(most, -(-rows.count() // per_range)))
    bounds = []
    if parts > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]))
    edges = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    return F.size(F.filter(edges, lambda b: b < F.col(order))), parts


def spent_before(rows: DataFrame, cost: Column | str, order: str = "ord", out: str = "spent_before", per_range: int = 200_000) -> DataFrame:
    """``rows`` with the sum of ``cost`` over all earlier rows; ``order`` must be a distinct number.

    Costs are summed as decimals of six places, so sums don't depend on the order of adding. See ``order_ranges`` for the ranges.
    """
    cost = F.col(cost) if isinstance(cost, str) else cost
    place, parts = order_ranges(rows, order, per_range)
    bucketed = rows.withColumns({"_spent_range": place, "_spent_cost": cost.cast("decimal(28,6)")})
    sums = {r["_spent_range"]: r.total for r in bucketed.groupBy("_spent_range").agg(F.sum("_spent_cost").alias("total")).collect()}  # a row for each range
    total, before = 0, []
    for b in range(parts):
        before.append(total)
        total += sums.get(b) or 0
    earlier = F.get(F.array(*(F.lit(str(x)).cast("decimal(38,6)") for x in before)), F.col("_spent_range"))
    inside = F.expr(f"coalesce(sum(_spent_cost) OVER (PARTITION BY _spent_range ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return bucketed.withColumn(out, (earlier + inside).cast("double")).drop("_spent_range", "_spent_cost")


def row_budget(rows: DataFrame, eligible: Column, limit: int, order: str = "ord") -> DataFrame:
    """Flag ``selected``: the first ``limit`` eligible rows in order."""
    counted = spent_before(rows, F.when(eligible, 1).otherwise(0), order, out="_seen")
    return counted.withColumn("selected", eligible & (F.col("_seen") < limit)).drop("_seen")


def query_budget(rows: DataFrame, need: str, limit: int, order: str = "ord") -> DataFrame:
    """``granted``: what is left of the budget when a row's turn comes, its need at most."""
    left = F.greatest(F.lit(0.0), F.lit(float(limit)) - F.col("spent_before"))
    return spent_before(rows, need, order).withColumn("granted", F.least(F.col(need).cast("double"), left).cast("long"))


def credit_budget(rows: DataFrame, cost: str, limit: float, order: str = "ord") -> DataFrame:
    """``runs``: a row runs while less than the budget was spent before it; the last one may overshoot."""
    return spent_before(rows, cost, order).withColumn("runs", F.col("spent_before") < limit)


def queries_until(hits: DataFrame, key: str, number: str, goal: Column, cap: Column) -> DataFrame:
    """For each key, how many queries it takes until a hit reaches the goal, ``cap`` at most (``cap`` is a column of the key)."""
    first = F.min(F.when(goal, F.col(number)))
    return hits.groupBy(key).agg(F.least(F.coalesce(first, cap), cap).alias("queries_needed"), first.isNotNull().alias("goal_reached"))


def query_cap(quality: Column) -> Column:
    return F.when(quality == "A++", 4).when(quality.isin("B", "C"), 2).otherwise(3)


def rotate_slice(queries: DataFrame, cursor: int, k: int, index: str = "idx") -> tuple[DataFrame, int]:
    """``k`` queries from the cursor on, cyclically, with their turn; and the next cursor."""
    n = queries.count()
    k = min(max(1, k), n)
    turn = F.pmod(F.col(index) - cursor, F.lit(max(n, 1)))
    return queries.withColumn("turn", turn).where(turn < k), (cursor + k) % max(n, 1)


def latest_checks(checks: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """The state of each key: its latest logged row."""
    return checks.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in checks.columns if c not in keys]), at).alias("s")).select(*keys, "s.*")


def cooldown_split(leads: DataFrame, checks: DataFrame, keys: list[str], now: Column, days: int, at: str = "ts") -> DataFrame:
    """Leads with their last check; ``skip_reason`` is domain_cooldown if it is less than ``days`` ago, else blank."""
    last = checks.groupBy(*keys).agg(F.max(at).alias("last_checked"))
    recent = F.col("last_checked") > now - F.make_dt_interval(F.lit(days))
    return leads.join(last, keys, "left").withColumn("skip_reason", F.when(recent, "domain_cooldown").otherwise(""))


def daily_counter(events: DataFrame, key: str, amount: Column | None = None, at: str = "ts") -> DataFrame:
    """Sum per day and key, in the session's time zone."""
    total = F.count("*") if amount is None else F.sum(amount)
    return events.groupBy(F.to_date(at).alias("day"), key).agg(total.alias("used"))


def daily_usage(used: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Usage with the limits of its key: what remains of each day's budget, never below zero."""
    return used.join(limits, key).withColumn("remaining", F.greatest(F.lit(0), F.col("daily_limit") - F.col("used")))
