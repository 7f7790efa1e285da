"""Scans of each derived history table (operator A1)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.session import scratch_path
from flowledger.sources.tables import read_exported_table

SCANS = {
    "jobs": "id, job_key, display_name, description, default_params_json",
    "runs": "id, run_key, job_id, status, triggered_by, params_json, queued_at, started_at, completed_at, "
    "parent_run_id, rerun_step_key, error_message",
    "queues": "id, queue_key, display_name, description, route_path, load_mode, load_poll_every_seconds",
    "queue_items": "id, queue_id, queue_item_key, partition_key, status, external_key, payload_json, queued_at",
    "run_steps": "run_id, step_key, sort_index, status, attempt, started_at, duration_ms, output_json, error_message",
    "run_events": "id, run_id, step_key, event_type, level, message, event_data_json, created_at",
    "job_edges": "job_id, from_step_key, to_step_key",
    "queue_item_runs": "id, queue_item_id, job_id, run_id, created_at",
    "schedules": "job_key, schedule_key, cron_expr, timezone, is_enabled, sort_index",
}

for _table, _columns in SCANS.items():
    query(f"A1_scan_{_table}", f"select {_columns} from @{_table}")(
        lambda h, t=_table, c=_columns: getattr(h, t).select(*[x.strip() for x in c.split(",")])
    )


def _exported(h, table: str, times: list[str], fraction: str = ""):
    """The table exported with times as text, in the forms a store writes, '' where there is none; then read back."""
    forms = [f"yyyy-MM-dd'T'HH:mm:ss{fraction}'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'", f"yyyy-MM-dd HH:mm:ss{fraction}", f"yyyy-MM-dd'T'HH:mm:ss{fraction}'+00:00'"]
    rows = getattr(h, table)

    def text(name):
        out = F.lit("")
        for i, form in enumerate(forms):
            out = F.when(F.col("id") % len(forms) == i, F.date_format(name, form)).otherwise(out)
        return F.coalesce(out, F.lit("")).alias(name)

    path = scratch_path(h.spark, "exported")
    rows.select(*[text(c) if c in times else F.col(c) for c in rows.columns]).write.parquet(path)
    return read_exported_table(h.spark, table, path)


query("A1_exported_runs", f"select {SCANS['runs']} from @runs")(
    lambda h: _exported(h, "runs", ["queued_at", "started_at", "completed_at"]).select(*[c.strip() for c in SCANS["runs"].split(",")])
)
query("A1_exported_events", f"select {SCANS['run_events']} from @run_events")(
    lambda h: _exported(h, "run_events", ["created_at"], ".SSSSSS").select(*[c.strip() for c in SCANS["run_events"].split(",")])
)
