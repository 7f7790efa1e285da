"""Status vocabularies. Each caller keeps its own normaliser; they differ on unknown words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowledger.functions.text import clean

# Display order of run and step statuses.
STATUS_ORDER = ("failed", "canceled", "running", "queued", "pending", "success", "skipped")
TERMINAL = ("success", "failed", "canceled")
# Stored spellings and the status that they show as.
DISPLAYED = {word: word for word in STATUS_ORDER} | {"cancelled": "canceled", "in_progress": "running", "idle": "pending"}
# Step groups of the run page.
STEP_GROUPS = ("preparing", "executing", "failed", "succeeded", "not_executed")


def exec_status(status: Column) -> Column:
    """Stored spelling to execution status: trimmed, lower case, one spelling of canceled."""
    word = F.lower(clean(status))
    return F.when(word == "cancelled", F.lit("canceled")).otherwise(word)


def is_terminal(status: Column) -> Column:
    return exec_status(status).isin(*TERMINAL)


def _looked_up(status: Column, words: dict[str, str], default: str) -> Column:
    """What ``words`` give for the trimmed status in lower case. Each spelling is listed, so a status is cleaned once a row."""
    table = F.create_map(*[F.lit(text) for pair in words.items() for text in pair])
    return F.coalesce(F.try_element_at(table, F.lower(clean(F.coalesce(status, F.lit(""))))), F.lit(default))


def _by_spelling(words: dict[str, str]) -> dict[str, str]:
    """``words`` of shown statuses as words of every spelling."""
    return {spelling: words[shown] for spelling, shown in DISPLAYED.items() if shown in words}


def display_status(status: Column) -> Column:
    """Status shown to users; unknown words show as pending."""
    return _looked_up(status, DISPLAYED, "pending")


def timeline_state(status: Column) -> Column:
    """State of a run on the timeline; unknown words count as running."""
    ended = {"failed": "failed", "canceled": "failed", "success": "succeeded", "skipped": "succeeded"}
    return _looked_up(status, _by_spelling(ended), "running")


def queue_status(status: Column) -> Column:
    """Status of a queue item from any stored spelling."""
    word = F.lower(clean(F.coalesce(status, F.lit(""))))
    return (
        F.when(word.isin("complete", "completed", "success"), F.lit("complete"))
        .when(word.isin("failed", "canceled", "cancelled"), F.lit("failed"))
        .when(word.isin("running", "in_progress"), F.lit("running"))
        .when(word.isin("queued", "not_started", "todo"), F.lit("queued"))
        .otherwise(F.lit("pending"))
    )


def step_group(status: Column) -> Column:
    groups = {"failed": "failed", "canceled": "failed", "running": "executing", "success": "succeeded", "skipped": "succeeded", "queued": "preparing"}
    return _looked_up(status, _by_spelling(groups), "not_executed")


def step_visual_state(status: Column) -> Column:
    states = {"failed": "failed", "canceled": "failed", "running": "running", "success": "succeeded", "skipped": "executed"}
    return _looked_up(status, _by_spelling(states), "not-executed")


def status_rank(status: Column) -> Column:
    """Zero-based place in STATUS_ORDER."""
    order = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return (F.array_position(order, display_status(status)) - 1).cast("long")


def is_active(status: Column) -> Column:
    return display_status(status).isin("running", "queued")
