"""Column layout of every history table. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"long": LongType(), "text": StringType(), "time": TimestampType(), "bool": BooleanType()}


def _table(spec: str) -> StructType:
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(StructField(name, _TYPES[kind]))
    return StructType(fields)


# Table and column names of the stored history.
TABLES: dict[str, StructType] = {
    "jobs": _table(
        "id:long job_key:text display_name:text description:text default_params_json:text created_at:time updated_at:time"
    ),
    "job_nodes": _table(
        "id:long job_id:long step_key:text display_name:text description:text kind:text metadata_json:text "
        "sort_index:long created_at:time"
    ),
    "job_edges": _table("id:long job_id:long from_step_key:text to_step_key:text created_at:time"),
    "runs": _table(
        "id:long run_key:text job_id:long status:text triggered_by:text params_json:text queued_at:time "
        "started_at:time completed_at:time parent_run_id:long rerun_step_key:text error_message:text "
        "created_at:time updated_at:time"
    ),
    "run_steps": _table(
        "id:long run_id:long job_node_id:long step_key:text status:text attempt:long started_at:time "
        "completed_at:time duration_ms:long output_json:text error_message:text log_excerpt:text "
        "created_at:time updated_at:time"
    ),
    "run_events": _table(
        "id:long run_id:long step_key:text event_type:text level:text message:text event_data_json:text created_at:time"
    ),
    "scheduler_heartbeats": _table(
        "scheduler_key:text last_heartbeat_at:time last_tick_started_at:time last_tick_completed_at:time "
        "last_error:text updated_at:time"
    ),
    "scheduler_schedule_state": _table(
        "job_key:text schedule_key:text last_checked_at:time last_enqueued_at:time next_run_at:time updated_at:time"
    ),
    "scheduler_schedule_runs": _table(
        "id:long job_key:text schedule_key:text scheduled_for:time run_key:text triggered_by:text "
        "created_at:time updated_at:time"
    ),
    "queues": _table(
        "id:long queue_key:text display_name:text description:text route_path:text load_mode:text "
        "load_poll_every_seconds:long created_at:time updated_at:time"
    ),
    "queue_jobs": _table("id:long queue_id:long job_id:long sort_index:long created_at:time"),
    "queue_items": _table(
        "id:long queue_id:long queue_item_key:text partition_key:text status:text external_key:text "
        "payload_json:text error_message:text queued_at:time started_at:time completed_at:time "
        "created_at:time updated_at:time"
    ),
    "queue_item_runs": _table("id:long queue_item_id:long job_id:long run_id:long created_at:time"),
    "queue_item_step_metadata": _table(
        "id:long queue_item_id:long job_id:long run_id:long step_key:text metadata_json:text "
        "created_at:time updated_at:time"
    ),
    # Schedules are declared, not stored; this is the shape callers pass in.
    "schedules": _table(
        "job_key:text schedule_key:text cron_expr:text timezone:text is_enabled:bool description:text sort_index:long"
    ),
}

# Natural key of each table that is written by keyed upsert or insert-if-absent.
NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "jobs": ("job_key",),
    "queues": ("queue_key",),
    "scheduler_heartbeats": ("scheduler_key",),
    "scheduler_schedule_state": ("job_key", "schedule_key"),
    "scheduler_schedule_runs": ("job_key", "schedule_key", "scheduled_for"),
    "queue_item_step_metadata": ("queue_item_id", "job_id", "step_key"),
    "queue_item_runs": ("queue_item_id", "job_id"),
    "run_steps": ("run_id", "step_key"),
}
