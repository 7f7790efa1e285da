"""Schedules as time series: ticks in a window, due ticks, next run, claims and inferred keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.cron import cron_spec, day_matches, local_time, zone_known, zone_or_utc
from flowledger.functions.text import clean
from flowledger.operators.calendars import DAY, calendar, minute_number, minute_time, parsed_specs, tasks
from flowledger.operators.latest import capped_occurrences
from flowledger.operators.schedule_keys import resolved_keys  # noqa: F401  (also offered here)
from flowledger.session import materialize

KEYS = ("job_key", "schedule_key")
# Timeline markers per schedule, due ticks per scheduler tick, seconds between ticks.
MAX_MARKERS = 720
MAX_DUE = 24
TICK_SECONDS = 15
# A schedule without a tick in five years has no next run: a parameter of ``next_ticks``.
HORIZON_DAYS = 5 * 366
# The next run is looked for in windows of so many days, each only for schedules without a tick so far.
NEXT_RUN_WINDOWS = (1, 31, 366, HORIZON_DAYS)


def _expression() -> Column:
    return F.lower(clean(F.coalesce("cron_expr", F.lit(""))))


def occurrences(
    schedules: DataFrame,
    start: Column,
    end: Column,
    keys: Sequence[str] = KEYS,
    cap: int | None = None,
    specs: DataFrame | None = None,
) -> DataFrame:
    """Minutes in (start, end] at which each schedule fires, as (keys, tick).

    Malformed expressions give no ticks; unknown zones count as UTC. An hour skipped by a clock change gives
    nothing and a repeated hour fires twice. The calendar is made once per distinct expression and zone, joined to the
    schedules by day, and the days are spread over all tasks before they become minutes, so one busy schedule
    does not fill one task.
    """
    keys = list(keys)
    bounded = schedules.select(
        *keys,
        _expression().alias("expr"),
        zone_or_utc(F.col("timezone")).alias("zone"),
        (minute_number(start) + 1).alias("first"),
        minute_number(end).alias("last"),
    )
    pairs = bounded.groupBy("expr", "zone").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    days = bounded.join(calendar(pairs, specs), ["expr", "zone"]).select(
        *keys, "base", "minutes", F.greatest("first", "low").alias("low"), F.least("last", "high").alias("high")
    )
    some = days.filter((F.col("low") <= F.col("high")) & (F.col("base") <= F.col("high")) & (F.col("base") + DAY > F.col("low")))
    spread = some.repartition(tasks(schedules.sparkSession), *keys, "base")
    minute = F.col("base") + F.col("minute")
    ticks = spread.select(*keys, "base", "low", "high", F.explode("minutes").alias("minute")).filter(minute.between(F.col("low"), F.col("high")))
    ticks = ticks.select(*keys, minute_time(minute).alias("tick"))
    return ticks if cap is None else capped_occurrences(ticks, keys, cap)


def matching_schedules(runs: DataFrame, schedules: DataFrame, time: str) -> DataFrame:
    """(run columns, schedule_key): the schedules of a run's job that fire in the minute of the run's ``time``.

    Distinct expressions become rows per minute of the day and meet runs on (job, zone, local minute of the day),
    so a run meets only what fires at that time of day; the day is then tested once per expression and zone. These rows are
    written first: known to be small, they go to the runs, which don't move, zone by zone, to meet them.
    What fires is spread over all tasks before it becomes a row per schedule: the result grows with runs times schedules.
    """
    wanted = schedules.select("job_key", "schedule_key", _expression().alias("expr"), zone_or_utc(F.col("timezone")).alias("zone"))
    wanted = materialize(wanted, "matched-schedules")
    specs = materialize(parsed_specs(wanted), "matched-specs")
    minutes = F.flatten(F.transform("spec.hour", lambda h: F.transform(F.col("spec.minute"), lambda m: (h * 60 + m).cast("short"))))
    by_minute = wanted.select("job_key", "expr", "zone").distinct().join(specs, "expr").select("job_key", "expr", "zone", F.explode(minutes).alias("minute"))
    by_minute = materialize(by_minute, "matched-minutes")
    # The time zone database has some hundred names, so the list of those in use is bounded.
    zones = wanted.agg(F.collect_set("zone").alias("zones")).scalar()
    local = local_time(F.col(time), F.col("zone"))
    placed = runs.withColumn("zone", F.explode(zones)).withColumn("minute", (F.hour(local) * 60 + F.minute(local)).cast("short"))
    same_time = placed.join(by_minute, ["job_key", "zone", "minute"]).join(specs, "expr")
    fired = same_time.filter(day_matches(F.col("spec"), F.to_date(local))).select(*runs.columns, "expr", "zone")
    fired = fired.repartition(tasks(schedules.sparkSession), *fired.columns)
    return fired.join(wanted, ["job_key", "expr", "zone"]).select(*runs.columns, "schedule_key")


def next_ticks(
    schedules: DataFrame, after: Column, keys: Sequence[str] = KEYS, windows: Sequence[int] = NEXT_RUN_WINDOWS
) -> DataFrame:
    """First tick of each schedule later than ``after``; no row where there is none in the last window.

    ``windows`` are days after ``after``, ascending. What a window finds is written, and the next one takes
    only the schedules that are left. Expressions are parsed once for all windows.
    """
    wanted = schedules.select(*keys, _expression().alias("cron_expr"), zone_or_utc(F.col("timezone")).alias("timezone"), after.alias("_after"))
    left = materialize(wanted, "next-run-schedules").withColumn("_from", F.col("_after"))
    specs = materialize(parsed_specs(left.select(F.col("cron_expr").alias("expr"))), "next-run-specs")
    found = None
    for days in windows:
        until = F.col("_after") + F.make_dt_interval(days=F.lit(days))
        ticks = occurrences(left, F.col("_from"), until, keys, specs=specs).groupBy(*keys).agg(F.min("tick").alias("next_run_at"))
        first = materialize(ticks, "next-runs")
        found = first if found is None else found.unionByName(first)
        left = left.join(first.select(*keys), list(keys), "left_anti").withColumn("_from", until)
    return found


def schedule_errors(schedules: DataFrame) -> DataFrame:
    """Schedules the scheduler cannot use, with the reason."""
    zone_error = F.concat(F.lit("invalid timezone "), F.col("timezone"))
    cron_error = F.concat(F.lit("invalid cron expression "), F.col("cron_expr"))
    error = F.when(~zone_known(F.col("timezone")), zone_error).when(
        ~cron_spec(F.col("cron_expr"))["valid"], cron_error
    )
    return schedules.withColumn("error", error).filter("error is not null")


def due_ticks(
    schedules: DataFrame, state: DataFrame, now: Column, tick_seconds: int = TICK_SECONDS, max_due: int = MAX_DUE
) -> DataFrame:
    """Ticks to start at ``now``: later than one scheduler interval ago and than the last one started.

    Older ticks are dropped, never caught up. Schedules with an unknown zone give nothing.
    """
    look_back = now - F.make_dt_interval(secs=F.lit(tick_seconds))
    known = (
        schedules.filter(zone_known(F.col("timezone")))
        .join(state.select(*KEYS, "last_enqueued_at"), list(KEYS), "left")
        .withColumn("base", F.greatest(look_back, F.col("last_enqueued_at")))
    )
    return occurrences(known, F.col("base"), now, cap=max_due)


def next_runs(schedules: DataFrame, due: DataFrame, now: Column, max_due: int = MAX_DUE) -> DataFrame:
    """Next run per schedule: after ``now``, or after the last kept tick where the cap cut ticks off."""
    counted = due.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("tick").alias("last_due"))
    known = (
        schedules.filter(zone_known(F.col("timezone")))
        .join(counted, list(KEYS), "left")
        .withColumn("after", F.when(F.col("n") >= max_due, F.col("last_due")).otherwise(now))
    )
    return next_ticks(known, F.col("after"))
