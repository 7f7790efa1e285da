"""Current state folded from the event log. The same functions serve a table and a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.streaming.sinks import BatchSink

# Events that move a run or a step, and the state they move it to.
RUN_EVENTS = {"run_queued": "queued", "run_started": "running", "run_failed": "failed", "run_canceled": "canceled"}
STEP_EVENTS = {
    "step_started": "running",
    "step_succeeded": "success",
    "step_failed": "failed",
    "step_skipped": "skipped",
    "step_canceled": "canceled",
}
TERMINAL_RUN_EVENTS = ("run_completed", "run_failed", "run_canceled")
ENDED_STEP_EVENTS = ("step_succeeded", "step_failed", "step_skipped", "step_canceled")


def _state(events: dict[str, str]) -> Column:
    kind = F.col("event_type")
    out = F.lit(None).cast("string")
    for name, state in events.items():
        out = F.when(kind == name, F.lit(state)).otherwise(out)
    return out


def event_state() -> Column:
    """The state that an event moves its run, or its step, to; null if it moves nothing."""
    completed = F.get_json_object("event_data_json", "$.status")
    of_run = F.when(F.col("event_type") == "run_completed", completed).otherwise(_state(RUN_EVENTS))
    return F.when(F.coalesce("step_key", F.lit("")) == "", of_run).otherwise(_state(STEP_EVENTS))


def run_states(events: DataFrame) -> DataFrame:
    """State of every run: its first terminal event decides, before that its latest event."""
    kind = F.col("event_type")
    state = F.when(kind == "run_completed", F.get_json_object("event_data_json", "$.status")).otherwise(
        _state(RUN_EVENTS)
    )
    terminal = kind.isin(*TERMINAL_RUN_EVENTS)
    moved = events.filter("step_key = ''").withColumn("state", state).filter("state is not null")
    return moved.groupBy("run_id").agg(
        F.coalesce(
            F.min_by(F.when(terminal, F.col("state")), F.when(terminal, F.col("id"))), F.max_by("state", "id")
        ).alias("status"),
        F.min(F.when(kind == "run_started", F.col("created_at"))).alias("started_at"),
        F.min_by(F.when(terminal, F.col("created_at")), F.when(terminal, F.col("id"))).alias("completed_at"),
    )


def step_states(events: DataFrame) -> DataFrame:
    """State of every step: its latest event decides."""
    kind = F.col("event_type")
    moved = events.filter("step_key <> ''").withColumn("state", _state(STEP_EVENTS)).filter("state is not null")
    ended = kind.isin(*ENDED_STEP_EVENTS)
    return moved.groupBy("run_id", "step_key").agg(
        F.max_by("state", "id").alias("status"),
        F.min(F.when(kind == "step_started", F.col("created_at"))).alias("started_at"),
        F.max(F.when(ended, F.col("created_at"))).alias("completed_at"),
    )


def latest_metadata(published: DataFrame) -> DataFrame:
    """Latest metadata per (item, job, step). Failed steps and empty maps publish nothing.

    ``published`` is (id, queue_item_id, job_id, run_id, step_key, status, metadata_json).
    """
    useful = published.filter("status = 'success' and trim(metadata_json) not in ('', '{}')")
    newest = useful.groupBy("queue_item_id", "job_id", "step_key").agg(
        F.max_by(F.struct("run_id", "metadata_json"), "id").alias("m")
    )
    return newest.select("queue_item_id", "job_id", "step_key", "m.run_id", "m.metadata_json")


def latest_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """Newest heartbeat of every scheduler, whole: it replaces all fields of the one before."""
    fields = ["last_tick_started_at", "last_tick_completed_at", "last_error"]
    newest = heartbeats.groupBy("scheduler_key").agg(
        F.max("last_heartbeat_at").alias("last_heartbeat_at"), F.max_by(F.struct(*fields), "last_heartbeat_at").alias("newest")
    )
    return newest.select("scheduler_key", "last_heartbeat_at", "newest.*")


def heartbeat_age(latest: DataFrame, now: Column) -> DataFrame:
    """Liveness: whole seconds since each scheduler was last heard of."""
    return latest.withColumn("age_seconds", F.unix_seconds(now) - F.unix_seconds("last_heartbeat_at"))


def updates_to(sink: BatchSink, table: str) -> Callable[[DataFrame, int], None]:
    """Batch function for update-mode streams: changed rows go to ``table``; read them with ``sink.latest``."""
    return lambda rows, batch_id: sink.write(batch_id, **{table: rows})
