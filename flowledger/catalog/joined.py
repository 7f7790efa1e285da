"""Joins (operators C1-C13)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.catalog.filters import _NODE_STATUS_SQL, node_status, paused_jobs
from flowledger.catalog.sqltext import EFFECTIVE
from flowledger.functions.times import literal_time, overview_window
from flowledger.operators import filters, joins

query(
    "C1_runs_with_jobs",
    """select r.id, r.run_key, r.status, j.job_key, j.display_name as job_display_name
       from @runs r join @jobs j on j.id = r.job_id""",
)(
    lambda h: joins.runs_with_jobs(h.runs, h.jobs).select("id", "run_key", "status", "job_key", "job_display_name")
)
query(
    "C2_items_with_queues",
    """select i.id, i.partition_key, q.queue_key, q.display_name as queue_display_name
       from @queue_items i join @queues q on q.id = i.queue_id""",
)(
    lambda h: joins.items_with_queues(h.queue_items, h.queues).select(
        "id", "partition_key", "queue_key", "queue_display_name"
    )
)
query(
    "C3_item_runs",
    """select l.queue_item_id, l.created_at, l.id, r.run_key, r.status as run_status, r.started_at, r.parent_run_id,
              j.job_key
       from @queue_item_runs l join @runs r on r.id = l.run_id join @jobs j on j.id = l.job_id""",
)(
    lambda h: joins.item_runs(h.queue_item_runs, h.runs, h.jobs)
    .select("queue_item_id", "created_at", "id", "run_key", "run_status", "started_at", "parent_run_id", "job_key")
)
query(
    "C4_items_without_runs",
    "select id from @queue_items i where not exists (select 1 from @queue_item_runs l where l.queue_item_id = i.id)",
)(lambda h: joins.without_links(h.queue_items, h.queue_item_runs).select("id"))
query(
    "C5_metadata_job_key",
    """select m.id, m.queue_item_id, coalesce(j.job_key, 'job') as job_key, m.step_key
       from @queue_item_step_metadata m
       left join (select distinct queue_item_id, job_id from @queue_item_runs) l
         on l.queue_item_id = m.queue_item_id and l.job_id = m.job_id
       left join @jobs j on j.id = l.job_id""",
)(
    lambda h: joins.metadata_with_job_key(h.queue_item_step_metadata, h.queue_item_runs, h.jobs).select(
        "id", "queue_item_id", "job_key", "step_key"
    )
)
query("C6_status_on_nodes", f"with ns as ({_NODE_STATUS_SQL}) select run_id, step_key, status from ns")(
    lambda h: node_status(h).select("run_id", "step_key", "status")
)
_SHORT_WINDOW_SQL = f"""select r.*, j.job_key from @runs r join @jobs j on j.id = r.job_id
    where {EFFECTIVE} between timestamp '2001-07-31 21:00:00' - interval 270 minutes
          and timestamp '2001-07-31 21:00:00' + interval 90 minutes + interval 60 seconds"""


def _short_window(h):
    start, _, render_end = overview_window(literal_time("2001-07-31 21:00:00"), 6)
    return filters.in_window(joins.runs_with_jobs(h.runs, h.jobs), filters.run_time(), start, render_end)


query(
    "C7_quiet_jobs",
    f"with w as ({_SHORT_WINDOW_SQL}) select job_key from @jobs j where j.job_key not in (select job_key from w)",
)(lambda h: joins.quiet_jobs(h.jobs, _short_window(h)).select("job_key"))
query(
    "C8_item_fan_out",
    """select i.id as item_id, k.job_id, k.sort_index from @queue_items i join @queue_jobs k on k.queue_id = i.queue_id""",
)(
    lambda h: joins.fan_out_items(h.queue_items, h.queue_jobs).select(F.col("id").alias("item_id"), "job_id", "sort_index")
)
query(
    "C9_step_fan_out",
    """select r.id as run_id, n.step_key, n.sort_index, 'pending' as status, cast(1 as bigint) as attempt,
              cast(0 as bigint) as duration_ms, '{}' as output_json, '' as error_message
       from @runs r join @job_nodes n on n.job_id = r.id""",
)(
    lambda h: joins.fan_out_steps(
        h.runs.select(F.col("id").alias("run_id"), F.col("id").alias("job_id")), h.job_nodes
    )
)
query(
    "C10_parent_outputs",
    """select r.id as run_id, r.parent_run_id, s.step_key, s.output_json
       from @runs r join @run_steps s on s.run_id = r.parent_run_id
       where r.parent_run_id > 0 and s.status = 'success'""",
)(lambda h: joins.parent_outputs(h.runs, h.run_steps).select("run_id", "parent_run_id", "step_key", "output_json"))
query(
    "C12_active_state",
    """select t.job_key, t.schedule_key, t.last_checked_at from @schedule_state t
       where exists (select 1 from @schedules s where s.is_enabled and s.job_key = t.job_key
                     and s.schedule_key = t.schedule_key and s.job_key not in (select job_key from @jobs where id = 5))""",
)(
    lambda h: joins.only_active(h.schedule_state, filters.enabled_schedules(h.schedules, paused_jobs(h))).select(
        "job_key", "schedule_key", "last_checked_at"
    )
)
query(
    "C12_active_claims",
    """select t.id, t.job_key, t.schedule_key from @schedule_claims t
       where exists (select 1 from @schedules s where s.is_enabled and s.job_key = t.job_key
                     and s.schedule_key = t.schedule_key and s.job_key not in (select job_key from @jobs where id = 5))""",
)(
    lambda h: joins.only_active(h.schedule_claims, filters.enabled_schedules(h.schedules, paused_jobs(h))).select(
        "id", "job_key", "schedule_key"
    )
)
query(
    "C13_sibling_runs",
    """select l.queue_item_id, l.run_id from @queue_item_runs l
       where l.queue_item_id in (select t.queue_item_id from @queue_item_runs t join @runs r on r.id = t.run_id
                                 where r.status = 'running')""",
)(
    lambda h: joins.touched_links(
        h.queue_item_runs, h.runs.filter("status = 'running'").select(F.col("id").alias("run_id"))
    ).select("queue_item_id", "run_id")
)
