"""One scheduler tick as DataFrames: what is due, who wins it, which runs start, what is remembered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.params import rfc3339, scheduled_params, scheduler_trigger
from flowledger.operators.joins import only_active
from flowledger.operators.schedules import KEYS, MAX_DUE, TICK_SECONDS, due_ticks, next_runs, schedule_errors
from flowledger.operators.store import QueuedRuns, insert_if_absent, insert_queued_runs, stable_key, upsert

CLAIM_KEY = ("job_key", "schedule_key", "scheduled_for")


@dataclass
class Tick:
    claims: DataFrame
    """Earlier claims of schedules that are still active."""
    won: DataFrame
    """Claims won by this tick."""
    queued: QueuedRuns
    errors: DataFrame
    find_state: Callable[[], DataFrame]

    @cached_property
    def state(self) -> DataFrame:
        """New schedule state; state of inactive schedules is gone. Searched for when it is first asked for."""
        return self.find_state()


def claim(due: DataFrame, claims: DataFrame) -> DataFrame:
    """Due ticks nobody has claimed, with the label and key of the run they start. Each column is part of the key."""
    wanted = due.select(*KEYS, F.col("tick").alias("scheduled_for"))
    won = insert_if_absent(claims, wanted, CLAIM_KEY, [F.col("scheduled_for")])
    return won.withColumns(
        {
            "triggered_by": scheduler_trigger(F.col("schedule_key")),
            "run_key": stable_key("run_", F.col("job_key"), F.col("schedule_key"), rfc3339(F.col("scheduled_for"))),
        }
    )


def startable_jobs(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """job_key of the jobs a run can be created for: known ones that have steps."""
    known = jobs.select(F.col("id").alias("job_id"), "job_key")
    return known.join(nodes.select("job_id"), "job_id", "left_semi").select("job_key").distinct()


def start_errors(schedules: DataFrame, due: DataFrame, startable: DataFrame) -> DataFrame:
    """Due schedules whose run can't be created, with the reason."""
    blocked = due.select(*KEYS).distinct().join(startable, "job_key", "left_anti")
    error = F.concat(F.lit("no run can be created for job "), F.col("job_key"))
    return schedules.join(blocked, list(KEYS), "left_semi").withColumn("error", error)


def scheduled_runs(won: DataFrame, jobs: DataFrame, nodes: DataFrame, now: Column, scheduler: str) -> QueuedRuns:
    """Queued runs of the claims won."""
    names = jobs.select(F.col("id").alias("job_id"), "job_key")
    requests = won.join(names, "job_key").select(
        "run_key",
        "job_id",
        "triggered_by",
        scheduled_params(F.col("scheduled_for"), F.col("schedule_key"), F.lit(scheduler)).alias("params_json"),
        now.alias("queued_at"),
        F.lit(0).cast("long").alias("parent_run_id"),
        F.lit("").alias("rerun_step_key"),
        F.lit("").alias("error_message"),
        F.create_map(
            F.lit("schedule_key"), F.col("schedule_key"), F.lit("scheduled_for"), rfc3339(F.col("scheduled_for"))
        ).alias("event_payload"),
    )
    return insert_queued_runs(requests, nodes, now)


def next_state(
    state: DataFrame, schedules: DataFrame, due: DataFrame, won: DataFrame, now: Column, max_due: int = MAX_DUE
) -> DataFrame:
    """State of every checked schedule: checked now, last tick started, next run."""
    started = won.groupBy(*KEYS).agg(F.max("scheduled_for").alias("started"))
    checked = (
        schedules.select(*KEYS)
        .join(state.select(*KEYS, F.col("last_enqueued_at").alias("before")), list(KEYS), "left")
        .join(started, list(KEYS), "left")
        .join(next_runs(schedules, due, now, max_due), list(KEYS), "left")
        .select(
            *KEYS,
            now.alias("last_checked_at"),
            F.coalesce("started", "before").alias("last_enqueued_at"),
            "next_run_at",
        )
    )
    columns = ["job_key", "schedule_key", "last_checked_at", "last_enqueued_at", "next_run_at"]
    base = state.withColumn("next_run_at", F.lit(None).cast("timestamp")) if "next_run_at" not in state.columns else state
    return upsert(base.select(*columns), checked.select(*columns), list(KEYS), [F.col("last_checked_at")])


def scheduler_tick(
    schedules: DataFrame,
    state: DataFrame,
    claims: DataFrame,
    jobs: DataFrame,
    nodes: DataFrame,
    now: Column,
    scheduler: str = "default",
    tick_seconds: int = TICK_SECONDS,
    max_due: int = MAX_DUE,
) -> Tick:
    """Everything one tick does. ``schedules`` are the enabled ones.

    Runs are keyed by (job, schedule, time), so a tick that is repeated after a failure starts nothing twice.
    """
    kept_state = only_active(state, schedules)
    kept_claims = only_active(claims, schedules)
    due = due_ticks(schedules, kept_state, now, tick_seconds, max_due)
    # A claim is for good, so it is only made for a run that can start; others are errors and stay due.
    startable = startable_jobs(jobs, nodes)
    won = claim(due.join(startable, "job_key", "left_semi"), kept_claims)
    return Tick(
        claims=kept_claims,
        won=won,
        queued=scheduled_runs(won, jobs, nodes, now, scheduler),
        errors=schedule_errors(schedules).unionByName(start_errors(schedules, due, startable)),
        find_state=lambda: next_state(kept_state, schedules, due, won, now, max_due),
    )
