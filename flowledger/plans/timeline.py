"""The timeline: runs that happened and scheduled ticks to come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.status import timeline_state
from flowledger.functions.times import duration_ms, millis, minute_of, start_time, timeline_time
from flowledger.operators.joins import unoccupied_ticks
from flowledger.operators.schedules import MAX_MARKERS, occurrences


def _run_time() -> Column:
    return timeline_time(F.col("triggered_by"), F.col("started_at"), F.col("queued_at"), F.col("completed_at"))


def occupied_minutes(runs: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Minutes in which a job has a run, of those in [start, end] where given.

    The time of a run is the first of three columns that is set, so each bound is put to the scan as a
    condition on those columns; the exact one follows.
    """
    if start is not None and end is not None:
        first, last = minute_of(start), minute_of(end) + F.expr("interval 1 minute")
        inside = lambda c: F.col(c).between(first, last)
        runs = runs.filter(inside("started_at") | inside("queued_at") | inside("completed_at"))
    minutes = runs.select("job_key", minute_of(_run_time()).alias("minute")).filter("minute is not null")
    return minutes if start is None else minutes.filter(F.col("minute").between(minute_of(start), minute_of(end)))


def run_artifacts(runs: DataFrame) -> DataFrame:
    start = start_time(F.col("started_at"), F.col("queued_at"), F.col("completed_at"))
    return runs.select(
        F.concat(F.lit("run-"), "id").alias("id"),
        F.lit("run").alias("kind"),
        "job_key",
        timeline_state(F.col("status")).alias("state"),
        _run_time().alias("ts"),
        start.alias("start_at"),
        F.col("completed_at").alias("end_at"),
        duration_ms(start, F.col("completed_at")).alias("duration_ms"),
        "run_key",
    )


def schedule_markers(
    runs: DataFrame, schedules: DataFrame, now: Column, start: Column, end: Column, cap: int | None = MAX_MARKERS
) -> DataFrame:
    """Future ticks not covered by a run of the same job in the same minute. The cap, None for all, counts covered ones too."""
    first = F.greatest(now, start)
    ticks = occurrences(schedules, first, end, cap=cap).withColumn("minute", F.col("tick"))
    free = unoccupied_ticks(ticks, occupied_minutes(runs, first, end))
    return free.select(
        F.concat_ws("-", F.lit("schedule"), "job_key", "schedule_key", millis(F.col("tick")).cast("string")).alias("id"),
        F.lit("schedule").alias("kind"),
        "job_key",
        F.lit("will_run").alias("state"),
        F.col("tick").alias("ts"),
        F.col("tick").alias("start_at"),
        F.col("tick").alias("end_at"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.lit("").alias("run_key"),
    )


def timeline(
    runs: DataFrame, schedules: DataFrame, now: Column, start: Column, end: Column, cap: int | None = MAX_MARKERS
) -> DataFrame:
    """Run artifacts and schedule markers; a page sorts them by time, then id. ``runs`` carries job_key."""
    return run_artifacts(runs).unionByName(schedule_markers(runs, schedules, now, start, end, cap))
