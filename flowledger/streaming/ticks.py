"""Scheduled ticks on a stream: one claim per tick, no catching up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.operators.schedules import KEYS, TICK_SECONDS


def on_time(ticks: DataFrame, now: Column, tick_seconds: int = TICK_SECONDS) -> DataFrame:
    """Ticks of the last scheduler interval; older ones are dropped for good, later ones are not due."""
    base = now - F.make_dt_interval(secs=F.lit(tick_seconds))
    return ticks.filter((F.col("scheduled_for") > base) & (F.col("scheduled_for") <= now))


def first_claims(ticks: DataFrame, keep_for: str | None = None) -> DataFrame:
    """First arrival of every (job, schedule, time).

    On a stream all keys seen are remembered, or with ``keep_for`` (``"10 minutes"``) only those within
    that span of the newest tick, which the on-time rule makes enough.
    """
    keys = [*KEYS, "scheduled_for"]
    if keep_for is None:
        return ticks.dropDuplicates(keys)
    return ticks.withWatermark("scheduled_for", keep_for).dropDuplicatesWithinWatermark(keys)
