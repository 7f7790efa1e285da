"""Projections, lookups and filters (operators B1-B12)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.catalog.sqltext import EFFECTIVE, display, group_of
from flowledger.functions.status import is_active
from flowledger.functions.times import literal_time, overview_window
from flowledger.operators import filters, joins, lookup

NOW = "2001-08-01 00:00:00"

query(
    "B1_item_run_projection",
    """select l.queue_item_id, l.run_id, r.status as run_status, r.error_message as run_error_message,
              j.display_name as job_display_name
       from @queue_item_runs l join @runs r on r.id = l.run_id join @jobs j on j.id = l.job_id""",
)(
    lambda h: joins.item_runs(h.queue_item_runs, h.runs, h.jobs).select(
        "queue_item_id", "run_id", "run_status", "run_error_message", "job_display_name"
    )
)

query("B2_job_by_key", "select id, job_key, display_name from @jobs where job_key = 'medium'")(
    lambda h: lookup.find(h.jobs, job_key="medium").select("id", "job_key", "display_name")
)
query("B2_run_by_id", "select id, run_key, job_id, status from @runs where id = 1042")(
    lambda h: lookup.find(h.runs, id=1042).select("id", "run_key", "job_id", "status")
)
query(
    "B2_step_by_run_and_key",
    "select run_id, step_key, status, duration_ms from @run_steps where run_id = 13 and step_key = 's5'",
)(lambda h: lookup.find(h.run_steps, run_id=13, step_key="s5").select("run_id", "step_key", "status", "duration_ms"))
query("B2_item_link_by_run", "select id, queue_item_id, job_id, run_id from @queue_item_runs where run_id = 77")(
    lambda h: lookup.find(h.queue_item_runs, run_id=77).select("id", "queue_item_id", "job_id", "run_id")
)
query(
    "B2_schedule_state_by_key",
    """select job_key, schedule_key, last_checked_at from @schedule_state
       where job_key = 'urgent' and schedule_key = 'sched_0'""",
)(
    lambda h: lookup.find(h.schedule_state, job_key="urgent", schedule_key="sched_0").select(
        "job_key", "schedule_key", "last_checked_at"
    )
)

query("B3_nodes_of_jobs", "select job_id, step_key, sort_index from @job_nodes order by job_id, sort_index, step_key")(
    lambda h: lookup.children(h.job_nodes, "job_id", ["sort_index", "step_key"]).select(
        "job_id", "step_key", "sort_index"
    )
)
query("B3_events_of_run", "select id, run_id, event_type from @run_events where run_id = 7 order by id")(
    lambda h: lookup.children(h.run_events, "run_id", ["id"], parent_id=7).select("id", "run_id", "event_type")
)
query("B3_items_of_queues", "select queue_id, id, created_at from @queue_items")(
    lambda h: lookup.children(h.queue_items, "queue_id", [F.col("created_at").desc(), F.col("id").desc()]).select(
        "queue_id", "id", "created_at"
    )
)
query(
    "B3_metadata_of_items",
    "select queue_item_id, job_id, step_key, id from @queue_item_step_metadata",
)(
    lambda h: lookup.children(h.queue_item_step_metadata, "queue_item_id", ["job_id", "step_key", "id"]).select(
        "queue_item_id", "job_id", "step_key", "id"
    )
)

query(
    "B4_purgeable_runs",
    """select id, completed_at from @runs where completed_at < timestamp '2000-01-01 00:00:00'
       and status in ('success', 'failed', 'canceled', 'cancelled')""",
)(
    lambda h: h.runs.filter(
        filters.purgeable(F.col("completed_at"), F.col("status"), literal_time("2000-01-01 00:00:00"))
    ).select("id", "completed_at")
)

_QUICK_SQL = {
    "backfills": "lower(triggered_by) like '%backfill%'",
    "queued": f"{display('status')} in ('queued', 'pending')",
    "in_progress": f"{display('status')} = 'running'",
    "failed": f"{display('status')} = 'failed'",
    "scheduled": "lower(triggered_by) like '%schedule%'",
    "all": "true",
}
for _name, _sql in _QUICK_SQL.items():
    query(f"B5_quick_filter_{_name}", f"select id, status, triggered_by from @runs where {_sql}")(
        lambda h, n=_name: h.runs.filter(filters.quick_filter(n, F.col("status"), F.col("triggered_by"))).select(
            "id", "status", "triggered_by"
        )
    )

query(
    "B6_run_list_filter",
    f"""select r.id, r.run_key, j.job_key from @runs r join @jobs j on j.id = r.job_id
        where lower(r.triggered_by) like '%schedule%' and j.job_key = 'medium' and {display('r.status')} = 'success'
          and coalesce(r.started_at, r.queued_at, r.completed_at) >= timestamp '{NOW}' - interval 20000 hours
          and lower(concat_ws(' ', r.run_key, j.job_key, r.triggered_by)) like '%1%'""",
)(
    lambda h: filters.filter_runs(
        joins.runs_with_jobs(h.runs, h.jobs),
        literal_time(NOW),
        quick="scheduled",
        job_key="medium",
        status="success",
        last_hours=20000,
        text=" 1 ",
    ).select("id", "run_key", "job_key")
)

# Graph runs: in the derived tables each run has its own graph, so run_id equals job_id. Pending step
# rows are left out so that their nodes fall back to the default status.
_NODE_STATUS_SQL = """
    select n.job_id as run_id, n.job_id, n.step_key, coalesce(s.status, 'pending') as status
    from @job_nodes n left join (select * from @run_steps where status <> 'pending') s
      on s.run_id = n.job_id and s.step_key = n.step_key"""


def node_status(h):
    runs = h.job_nodes.select(F.col("job_id").alias("run_id"), "job_id").distinct()
    return joins.node_status(runs, h.job_nodes, h.run_steps.filter("status <> 'pending'"))


query(
    "B7_event_filter",
    f"""with ns as ({_NODE_STATUS_SQL})
        select e.id, e.run_id, e.step_key, e.message from @run_events e
        where lower(trim(e.level)) = 'info' and lower(concat_ws(' ', e.event_type, e.message)) like '%stdout%'
          and lower(concat_ws(' ', e.step_key, e.event_type, e.level, e.message)) like '%st%'
          and (e.step_key = '' or exists (select 1 from ns where ns.run_id = e.run_id and ns.step_key = e.step_key
                                          and {group_of('ns.status')} = 'succeeded'))""",
)(
    lambda h: filters.filter_events(
        h.run_events, node_status(h), group="succeeded", level="info", stream="stdout", text="St"
    ).select("id", "run_id", "step_key", "message")
)

query(
    "B8_job_search",
    """select id, job_key from @jobs where lower(concat_ws(' ', display_name, job_key, description)) like '%h%'""",
)(lambda h: filters.search_jobs(h.jobs, "H").select("id", "job_key"))
query(
    "B8_overview_job_search",
    "select id, job_key from @jobs where lower(display_name) like '%low%' or lower(job_key) like '%low%'",
)(lambda h: filters.search_overview_jobs(h.jobs, "low").select("id", "job_key"))
query("B8_queue_search", """
    with t as (select q.id, q.queue_key, q.display_name, q.description, q.route_path,
                      string_agg(concat_ws(' ', j.display_name, j.job_key), ' ' order by k.sort_index) as jobs
               from @queues q left join @queue_jobs k on k.queue_id = q.id left join @jobs j on j.id = k.job_id
               group by all)
    select id, queue_key from t
    where lower(concat_ws(' ', display_name, queue_key, description, route_path, jobs)) like '%urgent%'""")(
    lambda h: filters.search_queues(h.queues, h.queue_jobs, h.jobs, "URGENT").select("id", "queue_key")
)
query("B8_queue_search_across_texts", """
    with t as (select q.id, q.queue_key, q.display_name, q.description, q.route_path,
                      string_agg(concat_ws(' ', j.display_name, j.job_key), ' ' order by k.sort_index) as jobs
               from @queues q left join @queue_jobs k on k.queue_id = q.id left join @jobs j on j.id = k.job_id
               group by all)
    select id, queue_key from t
    where lower(concat_ws(' ', display_name, queue_key, description, route_path, jobs)) like '%urgent 2-high high%'""")(
    lambda h: filters.search_queues(h.queues, h.queue_jobs, h.jobs, "urgent 2-HIGH high").select("id", "queue_key")
)

query(
    "B9_visible_nodes",
    f"with ns as ({_NODE_STATUS_SQL}) select run_id, step_key, status from ns where {group_of('status')} <> 'not_executed'",
)(
    lambda h: filters.visible_graph(node_status(h), h.job_edges, hide_unexecuted=True)[0].select(
        "run_id", "step_key", "status"
    )
)
query(
    "B9_visible_edges",
    f"""with ns as ({_NODE_STATUS_SQL}), vis as (select * from ns where {group_of('status')} = 'succeeded')
        select e.job_id as run_id, e.from_step_key, e.to_step_key from @job_edges e
        where exists (select 1 from vis where vis.run_id = e.job_id and vis.step_key = e.from_step_key)
          and exists (select 1 from vis where vis.run_id = e.job_id and vis.step_key = e.to_step_key)""",
)(
    lambda h: filters.visible_graph(node_status(h), h.job_edges, group="succeeded")[1].select(
        "run_id", "from_step_key", "to_step_key"
    )
)


def paused_jobs(h):
    return h.jobs.filter("id = 5").select("job_key")


query(
    "B10_enabled_schedules",
    """select s.job_key, s.schedule_key from @schedules s
       where s.is_enabled and s.job_key not in (select job_key from @jobs where id = 5)""",
)(lambda h: filters.enabled_schedules(h.schedules, paused_jobs(h)).select("job_key", "schedule_key"))
query(
    "B10_schedules_with_pause",
    """select s.job_key, s.schedule_key,
              s.is_enabled and s.job_key not in (select job_key from @jobs where id = 5) as is_enabled
       from @schedules s""",
)(
    lambda h: filters.schedules_with_state(h.schedules, paused_jobs(h)).select("job_key", "schedule_key", "is_enabled")
)

query("B11_active_runs", f"select id, status from @runs where {display('status')} in ('running', 'queued')")(
    lambda h: h.runs.filter(is_active(F.col("status"))).select("id", "status")
)


def runs_in_window(h):
    start, _, render_end = overview_window(literal_time(NOW), 2400)
    return filters.in_window(joins.runs_with_jobs(h.runs, h.jobs), filters.run_time(), start, render_end)


WINDOW_SQL = f"""select r.*, j.job_key from @runs r join @jobs j on j.id = r.job_id
    where {EFFECTIVE} between timestamp '{NOW}' - interval 1800 hours
          and timestamp '{NOW}' + interval 600 hours + interval 60 seconds"""
query("B12_runs_in_window", f"with w as ({WINDOW_SQL}) select id, job_key from w")(
    lambda h: runs_in_window(h).select("id", "job_key")
)
