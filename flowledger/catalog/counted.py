"""Aggregations (operators D1-D19, without those on graphs and retention)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.catalog.filters import _NODE_STATUS_SQL, _QUICK_SQL, WINDOW_SQL, node_status, runs_in_window
from flowledger.catalog.sqltext import display, executed, group_of, rank_of
from flowledger.operators import counts, joins

for _table in ("jobs", "runs", "queues"):
    query(f"D1_count_{_table}", f"select count(*) as total from @{_table}")(
        lambda h, t=_table: counts.count_by(getattr(h, t))
    )
for _table, _key in (("runs", "job_id"), ("run_events", "run_id"), ("queue_items", "queue_id")):
    query(f"D1_count_{_table}_by_{_key}", f"select {_key}, count(*) as total from @{_table} group by 1")(
        lambda h, t=_table, k=_key: counts.count_by(getattr(h, t), k)
    )

query("D2_items_by_status", "select queue_id, status, count(*) as total from @settled_items group by 1, 2")(
    lambda h: counts.count_by(h.settled_items, "queue_id", "status").orderBy("queue_id", "status")
)
query(
    "D3_partitions_per_queue", "select queue_id, count(distinct partition_key) as partitions from @queue_items group by 1"
)(lambda h: counts.partitions_per_queue(h.queue_items))
query("D4_distinct_schedules", "select distinct job_key, schedule_key from @schedule_claims")(
    lambda h: counts.distinct_schedules(h.schedule_claims)
)

_STEP_SUMS = ", ".join(
    f"count(*) filter (where s.status = '{s}') as {s}_steps" for s in counts.STEP_COUNTERS
)
query(
    "D5_run_summary",
    f"""select r.id, r.run_key, j.job_key, r.status, r.triggered_by, r.queued_at, r.started_at, r.completed_at,
               {_STEP_SUMS}
        from @runs r join @jobs j on j.id = r.job_id left join @run_steps s on s.run_id = r.id
        group by all""",
)(
    lambda h: counts.run_summary(joins.runs_with_jobs(h.runs, h.jobs), h.run_steps)
    .select(
        "id", "run_key", "job_key", "status", "triggered_by", "queued_at", "started_at", "completed_at",
        *[f"{s}_steps" for s in counts.STEP_COUNTERS],
    )
)

LIFECYCLE_SQL = f"""
    select l.queue_item_id,
           case when bool_and({executed('r.status')} = 'queued') then 'queued'
                when bool_or({executed('r.status')} in ('queued', 'running')) then 'running'
                when bool_and({executed('r.status')} = 'success') then 'complete' else 'failed' end as status,
           min(r.started_at) as started_at,
           case when not bool_or({executed('r.status')} in ('queued', 'running')) then max(r.completed_at) end
               as completed_at,
           case when bool_and({executed('r.status')} = 'success') then '' else coalesce(
               first(r.error_message order by l.created_at, l.id) filter (where r.error_message <> ''), '') end
               as error_message
    from @queue_item_runs l join @runs r on r.id = l.run_id group by 1"""
query("D6_item_lifecycle", LIFECYCLE_SQL)(
    lambda h: counts.item_lifecycle(joins.links_with_runs(h.queue_item_runs, h.runs))
)

_QUEUE_SUMMARY_SQL = """
    select q.id, q.queue_key, count(i.id) as item_count, count(distinct i.partition_key) as partition_count,
           count(*) filter (where i.status = 'queued') as queued_count,
           count(*) filter (where i.status = 'running') as running_count,
           count(*) filter (where i.status = 'complete') as complete_count,
           count(*) filter (where i.status = 'failed') as failed_count
    from @queues q left join @settled_items i on i.queue_id = q.id group by 1, 2"""
query("D7_queue_summary", _QUEUE_SUMMARY_SQL)(
    lambda h: counts.queue_summary(h.queues, h.settled_items).select(
        "id", "queue_key", "item_count", "partition_count", "queued_count", "running_count", "complete_count",
        "failed_count",
    )
)
query(
    "D8_queue_totals",
    f"""with s as ({_QUEUE_SUMMARY_SQL})
        select cast(sum(item_count) as bigint) as items, cast(sum(partition_count) as bigint) as partitions,
               cast(sum(queued_count) as bigint) as queued, cast(sum(running_count) as bigint) as running,
               cast(sum(complete_count) as bigint) as complete, cast(sum(failed_count) as bigint) as failed from s""",
)(lambda h: counts.queue_totals(counts.queue_summary(h.queues, h.settled_items)))

query(
    "D9_overview",
    f"""with w as ({WINDOW_SQL})
        select (select count(*) from @runs where {display('status')} in ('running', 'queued')) as running_now,
               (select count(*) from w where {display('status')} = 'failed') as failed_in_window,
               (select count(*) from w where {display('status')} = 'success') as success_in_window,
               (select count(*) from w) as total_runs_in_window,
               (select count(*) from @schedules where is_enabled) as enabled_schedules,
               (select count(*) from @jobs j where j.job_key not in (select job_key from w)) as quiet_jobs""",
)(
    lambda h: counts.overview_stats(
        h.runs, runs_in_window(h), h.schedules, joins.quiet_jobs(h.jobs, runs_in_window(h))
    )
)

query(
    "D10_quick_counts",
    "select " + ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in _QUICK_SQL.items()) + " from @runs",
)(lambda h: counts.quick_counts(h.runs))

query(
    "D11_group_counts",
    f"""with ns as ({_NODE_STATUS_SQL})
        select run_id, {group_of('status')} as step_group, count(*) as steps from ns group by 1, 2""",
)(lambda h: counts.group_counts(node_status(h)))
query(
    "D11_group_members",
    f"with ns as ({_NODE_STATUS_SQL}) select run_id, {group_of('status')} as step_group, step_key from ns",
)(lambda h: counts.group_members(node_status(h)))

query(
    "D12_item_metadata",
    """with m as (select m.id, m.queue_item_id, m.job_id, coalesce(j.job_key, 'job') as job_key, m.step_key, m.metadata_json
                 from @queue_item_step_metadata m
                 left join (select distinct queue_item_id, job_id from @queue_item_runs) l
                   on l.queue_item_id = m.queue_item_id and l.job_id = m.job_id
                 left join @jobs j on j.id = l.job_id),
       last as (select queue_item_id, job_key, step_key, last(metadata_json order by job_id, id) as raw from m group by 1, 2, 3)
       select queue_item_id, job_key, step_key,
              case when json_valid(raw) then cast(json(raw) as varchar) else '{}' end as metadata_json from last""",
)(
    lambda h: counts.item_metadata(
        joins.metadata_with_job_key(h.queue_item_step_metadata, h.queue_item_runs, h.jobs)
    )
)

query("D13_event_levels", "select distinct run_id, lower(trim(level)) as level from @run_events where trim(level) <> ''")(
    lambda h: counts.event_levels(h.run_events)
)
query(
    "D14_run_statuses",
    f"select distinct {display('status')} as status, cast({rank_of('status')} as bigint) as rank from @spellings",
)(lambda h: counts.run_statuses(h.spellings))
query(
    "D17_jobs_of_queues",
    """select k.queue_id, k.sort_index, j.job_key, j.display_name from @queue_jobs k join @jobs j on j.id = k.job_id""",
)(lambda h: counts.jobs_of_queues(h.queue_jobs, h.jobs))
query(
    "D18_schedules_of_jobs",
    """select job_key, count(*) as schedules, count(*) filter (where is_enabled) as enabled_schedules
       from @schedules group by 1""",
)(lambda h: counts.schedules_of_jobs(h.schedules))
query(
    "D19_queue_latency",
    """with w as (select job_id, epoch_ms(started_at) - epoch_ms(queued_at) as ms from @runs where started_at is not null)
       select job_id, count(*) as started_runs, round(sum(ms) / count(*), 3) as mean_ms,
              quantile_disc(ms, 0.5) as p50_ms, quantile_disc(ms, 0.95) as p95_ms from w group by 1""",
)(lambda h: counts.queue_latency(h.runs))
