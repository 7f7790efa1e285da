"""Event log scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowledger.functions.text import clean, non_empty

# Numeric log levels and the level names they map to.
LOG_LEVEL_FLOOR = {"info": 0, "warn": 4, "error": 8}
# Longest message and payload returned to callers, in characters.
MAX_MESSAGE = 2048
MAX_EVENT_DATA = 8192


def event_level(level: Column) -> Column:
    return F.lower(clean(F.coalesce(level, F.lit(""))))


def is_error_event(level: Column, event_type: Column) -> Column:
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    return event_level(level).isin("error", "fatal") | F.contains(kind, F.lit("fail")) | F.contains(kind, F.lit("error"))


def is_warning_event(level: Column, event_type: Column) -> Column:
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    return event_level(level).isin("warn", "warning") | F.contains(kind, F.lit("warn"))


def severity(level: Column, event_type: Column) -> Column:
    """error before warning; '' for everything else."""
    return (
        F.when(is_error_event(level, event_type), F.lit("error"))
        .when(is_warning_event(level, event_type), F.lit("warning"))
        .otherwise(F.lit(""))
    )


def outcome_class(event_type: Column) -> Column:
    kind = F.lower(clean(F.coalesce(event_type, F.lit(""))))
    return (
        F.when(kind == "step_succeeded", F.lit("step-succeeded"))
        .when(kind == "step_failed", F.lit("step-failed"))
        .otherwise(F.lit(""))
    )


def level_name(number: Column) -> Column:
    """Numeric log level to event level."""
    return (
        F.when(number >= LOG_LEVEL_FLOOR["error"], F.lit("error"))
        .when(number >= LOG_LEVEL_FLOOR["warn"], F.lit("warn"))
        .when(number >= LOG_LEVEL_FLOOR["info"], F.lit("info"))
        .otherwise(F.lit("debug"))
    )


def log_message(message: Column) -> Column:
    return non_empty(message, F.lit("step log"))


def in_stream(event_type: Column, message: Column, stream: str) -> Column:
    """Whether an event came from ``stdout`` or ``stderr``; ``all`` keeps every event."""
    if stream == "all":
        return F.lit(True)
    wanted = "stdout" if stream == "stdout" else "stderr"
    return F.contains(F.lower(F.concat_ws(" ", event_type, message)), F.lit(wanted))
