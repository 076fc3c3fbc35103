"""States as expressions (J07, J09, J11): what a row of facts says at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.dates import micros_between


def backoff_minutes(attempts: Column) -> Column:
    """1, 2, 4, ... minutes, at most 60."""
    return F.least(F.lit(60).cast("bigint"), F.pow(F.lit(2), attempts - 1).cast("bigint"))


def job_state(done: Column, attempts: Column, leased_at: Column, now: Column, *, most: int = 5, lease_minutes: int = 10) -> Column:
    """Done; dead after the last attempt; retry once the lease ran out; leased until then."""
    expired = micros_between(leased_at, now) > lease_minutes * 60_000_000
    return F.when(done, "done").when(attempts >= most, "dead").when(expired, "retry").otherwise("leased")


def health(last_sync: Column, now: Column, *, stale_hours: int = 36, broken_days: int = 4) -> Column:
    """Healthy, stale or broken by the time since the last success; never without one."""
    age = micros_between(last_sync, now)
    return F.when(last_sync.isNull(), "never").when(age > broken_days * 86_400_000_000, "broken").when(age > stale_hours * 3_600_000_000, "stale").otherwise("healthy")


def due_steps(progress: DataFrame, steps: DataFrame, today: Column, *, close_day: str = "close_on") -> DataFrame:
    """Steps of a close (name, offset days) that are due and not done, late ones first in plan order.

    ``progress`` (key, close_on, done array<string>); ``steps`` (step, offset) is a small plan.
    """
    due = progress.join(F.broadcast(steps)).withColumn("due_on", F.expr(f"date_add({close_day}, offset)"))
    return due.where((F.col("due_on") <= today) & ~F.array_contains("done", F.col("step"))).withColumn("late", F.col("due_on") < today)
