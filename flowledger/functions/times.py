"""Times: all instants are TimestampType read in UTC; absent times are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowledger.functions.status import display_status
from flowledger.functions.text import clean

# Share of the overview window that lies before now, and the slack drawn after its end.
PAST_SHARE = 0.75
RENDER_SLACK_SECONDS = 60

_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"


def stored_time(text: Column) -> Column:
    """Stored text to an instant: RFC 3339 with any fraction, or a plain UTC date-time; else NULL."""
    known = text.rlike(_ZONED) | text.rlike(_PLAIN)
    return F.when(known, F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def effective_time(started: Column, queued: Column, completed: Column) -> Column:
    """The time a run is placed at: started, else queued, else completed."""
    return F.coalesce(started, queued, completed)


def start_time(started: Column, queued: Column, completed: Column) -> Column:
    return F.coalesce(started, queued, effective_time(started, queued, completed))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; 0 when an end is missing or lies before the start."""
    return F.when(end > start, millis(end) - millis(start)).otherwise(F.lit(0).cast("long"))


def step_duration_ms(stored_ms: Column, started: Column, now: Column) -> Column:
    """Stored duration if positive, else the time since the start, never negative."""
    return F.when(stored_ms > 0, stored_ms).otherwise(duration_ms(started, now))


def live_duration_ms(stored_ms: Column, start: Column, end: Column, state: Column, now: Column) -> Column:
    """Duration of a timeline marker: stored, else end - start, else running time so far."""
    return (
        F.when(stored_ms > 0, stored_ms)
        .when(end > start, millis(end) - millis(start))
        .when((state == "running") & (now > start), millis(now) - millis(start))
        .otherwise(F.lit(0).cast("long"))
    )


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def is_scheduler_triggered(triggered_by: Column) -> Column:
    return F.startswith(F.lower(clean(F.coalesce(triggered_by, F.lit("")))), F.lit("scheduler:"))


def timeline_time(triggered_by: Column, started: Column, queued: Column, completed: Column) -> Column:
    """Effective time, snapped to its minute when the scheduler started the run."""
    ts = effective_time(started, queued, completed)
    return F.when(is_scheduler_triggered(triggered_by), minute_of(ts)).otherwise(ts)


def retention_cutoff(now: Column, days: int) -> Column:
    """``days`` calendar days before ``now``; in UTC a calendar day is 24 hours."""
    return now - F.make_dt_interval(days=F.lit(days))


def overview_window(now: Column, hours: int) -> tuple[Column, Column, Column]:
    """Start, end and render end of the overview: three quarters past, one quarter future."""
    past_ms = round(hours * 3_600_000 * PAST_SHARE)
    future_ms = hours * 3_600_000 - past_ms

    def shift(ms: int) -> Column:
        return now + F.make_dt_interval(secs=F.lit(ms / 1000))

    return shift(-past_ms), shift(future_ms), shift(future_ms + RENDER_SLACK_SECONDS * 1000)


def literal_time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def is_running(status: Column) -> Column:
    return display_status(status) == "running"
