"""Windows, sorts and pages (operators E1-E3, E5, E7, F1-F6)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.catalog.filters import WINDOW_SQL, runs_in_window
from flowledger.catalog.sqltext import EFFECTIVE
from flowledger.functions.times import literal_time
from flowledger.operators import joins, latest, lookup, ordering, retention
from flowledger.plans import run_list


def _runs(h):
    return joins.runs_with_jobs(h.runs, h.jobs)


query(
    "E1_latest_item_per_partition",
    """select id, queue_id, partition_key, status, created_at from
       (select *, row_number() over (partition by queue_id, partition_key order by created_at desc, id desc) as rn
        from @settled_items) t where rn = 1""",
)(
    lambda h: latest.latest_item_per_partition(h.settled_items).select(
        "id", "queue_id", "partition_key", "status", "created_at"
    )
)
_RANKED = f"""select r.id, r.run_key, j.job_key, row_number() over (partition by j.job_key
    order by {EFFECTIVE} desc, r.id desc) as rank from @runs r join @jobs j on j.id = r.job_id"""
query("E2_latest_run_per_job", f"select id, run_key, job_key from ({_RANKED}) t where rank = 1")(
    lambda h: latest.latest_run_per_job(_runs(h)).select("id", "run_key", "job_key")
)
query("E3_health_tiles", f"select id, job_key, rank from ({_RANKED}) t where rank <= 5")(
    lambda h: latest.health_tiles(_runs(h)).select("id", "job_key", "rank")
)
query(
    "E5_event_tail",
    """select id, run_id, event_type, total from (select *, count(*) over (partition by run_id) as total,
       row_number() over (partition by run_id order by id desc) as rn from @run_events) t where rn <= 25""",
)(lambda h: latest.event_tail(h.run_events, lookup.DEFAULT_PAGE).select("id", "run_id", "event_type", "total"))
query("E7_runs_of_jobs", f"with w as ({WINDOW_SQL}) select job_key, {EFFECTIVE} as ts, id from w")(
    lambda h: latest.runs_of_jobs_in_order(runs_in_window(h)).select(
        "job_key", F.coalesce("started_at", "queued_at", "completed_at").alias("ts"), "id"
    )
)

query("F1_run_page", "select id, run_key, status from @runs order by id desc limit 200 offset 50")(
    lambda h: lookup.page(h.runs, [F.col("id").desc()], limit=1000, offset=50).select("id", "run_key", "status")
)
query("F1_job_page", "select id, job_key from @jobs order by job_key limit 25")(
    lambda h: lookup.page(h.jobs, [F.col("job_key").asc()]).select("id", "job_key")
)
query(
    "F2_items_newest_first",
    "select id, created_at from @queue_items order by created_at desc, id desc limit 100",
)(
    lambda h: lookup.page(h.queue_items, [F.col("created_at").desc(), F.col("id").desc()], limit=100).select(
        "id", "created_at"
    )
)
_LENGTH = "case when completed_at > started_at then epoch_ms(completed_at) - epoch_ms(started_at) else 0 end"
query("F3_longest_runs", f"select id, {_LENGTH} as ms from @runs order by ms desc, {EFFECTIVE} desc, id desc limit 50")(
    lambda h: run_list.run_page(_runs(h), literal_time("2001-08-01 00:00:00"), sort="duration_desc").select(
        "id", F.col("duration_ms").alias("ms")
    )
)
query("F3_oldest_runs", f"select id, {EFFECTIVE} as ts from @runs order by ts, id limit 50")(
    lambda h: run_list.run_page(_runs(h), literal_time("2001-08-01 00:00:00"), sort="oldest").select("id", "ts")
)
query(
    "F4_freshest_runs",
    f"select id, job_key from (select r.*, j.job_key from @runs r join @jobs j on j.id = r.job_id) t"
    f" where job_key = 'high' order by {EFFECTIVE} desc, id desc limit 20",
)(lambda h: ordering.by_freshness(lookup.find(_runs(h), job_key="high")).limit(20).select("id", "job_key"))
query(
    "F5_purge_batch",
    """select id, completed_at from @runs where completed_at < timestamp '2000-01-01 00:00:00'
       and status in ('success', 'failed', 'canceled', 'cancelled') order by completed_at, id limit 1000""",
)(
    lambda h: retention.purge_batch(h.runs, literal_time("2000-01-01 00:00:00")).select("id", "completed_at")
)
query("F6_jobs_by_label", "select id, job_key, coalesce(nullif(display_name, ''), job_key) as label from @jobs")(
    lambda h: ordering.by_label(h.jobs, "job_key").select(
        "id", "job_key", F.expr("coalesce(nullif(display_name, ''), job_key)").alias("label")
    )
)
