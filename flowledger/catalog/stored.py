"""Writes, set logic and retention (operators A6-A11, D15, G2-G4)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.catalog.core import ORACLES, query
from flowledger.functions.times import literal_time
from flowledger.operators import counts, joins, monthly, retention, store
from flowledger.session import materialize, scratch_path

NOW = "2001-08-01 00:00:00"


def _appended_events(h):
    path = scratch_path(h.spark, "events")
    created = h.runs.select(
        *store.new_event(F.col("id").alias("run_id"), F.lit(""), "run_started", "info", F.lit("run started"))
    )
    done = h.runs.filter("completed_at is not null").select(
        *store.new_event(
            F.col("id").alias("run_id"),
            F.lit(""),
            "run_completed",
            "info",
            F.lit("run completed"),
            F.create_map(F.lit("status"), F.col("status")),
        )
    )
    store.append(created, path)
    store.append(done, path)
    return h.spark.read.schema(created.schema).parquet(path)


query(
    "A6_event_append",
    """select id as run_id, '' as step_key, 'run_started' as event_type, 'info' as level, 'run started' as message,
              '{}' as event_data_json from @runs
       union all
       select id, '', 'run_completed', 'info', 'run completed', '{"status":"' || status || '"}' from @runs
       where completed_at is not null""",
)(_appended_events)


def _queued(h):
    """As in ingestion, the queues' jobs and their nodes are written first: known to be small, they go to the items, which don't move to meet them."""
    queue_jobs = materialize(h.queue_jobs, "queue-jobs")
    nodes = materialize(h.job_nodes.join(queue_jobs.select("job_id").distinct(), "job_id", "left_semi"), "queue-nodes")
    requests = h.queue_items.join(queue_jobs, "queue_id").select(
        store.stable_key("run_", F.col("queue_item_key"), F.col("job_id").cast("string")).alias("run_key"),
        "job_id",
        F.concat(F.lit(" queue:"), F.col("queue_id")).alias("triggered_by"),
        F.lit(" ").alias("params_json"),
        F.when(F.col("id") % 2 == 0, F.col("queued_at")).alias("queued_at"),
        F.lit(0).cast("long").alias("parent_run_id"),
        F.lit("").alias("rerun_step_key"),
        F.lit("").alias("error_message"),
        F.create_map(F.lit("queue_item_id"), F.col("id").cast("string")).alias("event_payload"),
    )
    return store.insert_queued_runs(requests, nodes, literal_time(NOW))


_REQUESTS_SQL = """
    select 'run_' || sha256(i.queue_item_key || chr(0) || k.job_id) as run_key, k.job_id, i.queue_id, i.id, i.queued_at
    from @queue_items i join @queue_jobs k on k.queue_id = i.queue_id
    where exists (select 1 from @job_nodes n where n.job_id = k.job_id)"""
query(
    "A7_queued_runs",
    f"""with q as ({_REQUESTS_SQL})
        select run_key, job_id, 'queued' as status, 'queue:' || queue_id as triggered_by, '{{}}' as params_json,
               case when id % 2 = 0 then queued_at else timestamp '{NOW}' end as queued_at,
               cast(0 as bigint) as parent_run_id, '' as rerun_step_key, '' as error_message from q""",
)(lambda h: _queued(h).runs)
query(
    "A7_queued_steps",
    f"""with q as ({_REQUESTS_SQL})
        select q.run_key, n.step_key, n.sort_index, 'pending' as status, cast(1 as bigint) as attempt,
               cast(0 as bigint) as duration_ms, '{{}}' as output_json, '' as error_message
        from q join @job_nodes n on n.job_id = q.job_id""",
)(lambda h: _queued(h).steps)
query(
    "A7_queued_events",
    f"""with q as ({_REQUESTS_SQL})
        select run_key, '' as step_key, 'run_queued' as event_type, 'info' as level, 'run queued' as message,
               '{{"parent_run_id":"0","queue_item_id":"' || id || '","rerun_step_key":"","triggered_by":"queue:'
               || queue_id || '"}}' as event_data_json from q""",
)(lambda h: _queued(h).events)


def _upserted(h):
    rows = h.queue_item_step_metadata
    base = rows.groupBy("queue_item_id", "job_id", "step_key").agg(
        F.min("id").alias("id"), F.min_by("run_id", "id").alias("run_id"), F.min_by("metadata_json", "id").alias("metadata_json")
    )
    updates = rows.filter("run_id % 2 = 0").unionByName(rows.withColumn("job_id", F.lit(0).cast("long"))).withColumn(
        "metadata_json", F.concat(F.lit("new "), "metadata_json")
    )
    return store.upsert(base, updates, ["queue_item_id", "job_id", "step_key"], [F.col("run_id")], keep=["id"])


query(
    "A8_keyed_upsert",
    """with b as (select queue_item_id, job_id, step_key, min(id) as id, arg_min(run_id, id) as run_id,
                        arg_min(metadata_json, id) as metadata_json from @queue_item_step_metadata group by 1, 2, 3),
       u as (select queue_item_id, job_id, step_key, arg_max(id, run_id) as id, max(run_id) as run_id,
                    'new ' || arg_max(metadata_json, run_id) as metadata_json
             from (select * from @queue_item_step_metadata where run_id % 2 = 0
                   union all by name select * replace (cast(0 as bigint) as job_id) from @queue_item_step_metadata) x
             group by 1, 2, 3)
       select queue_item_id, job_id, step_key, coalesce(b.id, u.id) as id, coalesce(u.run_id, b.run_id) as run_id,
              coalesce(u.metadata_json, b.metadata_json) as metadata_json
       from b full join u using (queue_item_id, job_id, step_key)""",
)(_upserted)


def _claims(h):
    due = h.schedules.select(
        "job_key", "schedule_key", F.explode(F.array(*[literal_time(f"2024-01-10 12:0{m}:00") for m in (0, 5)])).alias(
            "scheduled_for"
        )
    )
    twice = due.unionByName(due)
    return store.insert_if_absent(h.schedule_claims, twice, ["job_key", "schedule_key", "scheduled_for"], [F.col("scheduled_for")])


query(
    "A9_insert_if_absent",
    """select s.job_key, s.schedule_key, t.due as scheduled_for from @schedules s,
              (values (timestamp '2024-01-10 12:00:00'), (timestamp '2024-01-10 12:05:00')) t(due)
       where not exists (select 1 from @schedule_claims c where c.job_key = s.job_key
                         and c.schedule_key = s.schedule_key and c.scheduled_for = t.due)""",
)(_claims)


def _replaced(h):
    parents = h.runs.filter("status = 'failed'").select(F.col("id").alias("job_id"))
    nodes = h.job_nodes.select("job_id", "step_key", "sort_index").join(parents, "job_id", "left_semi")
    after = nodes.select("job_id", F.col("step_key").alias("to_step_key"), (F.col("sort_index") - 1).alias("sort_index"))
    chain = nodes.withColumnRenamed("step_key", "from_step_key").join(after, ["job_id", "sort_index"]).drop("sort_index")
    return store.replace_children(h.job_edges, parents, chain, "job_id")


query(
    "A10_replace_children",
    """select e.* from @job_edges e where e.job_id not in (select id from @runs where status = 'failed')
       union all
       select a.job_id, a.step_key, b.step_key from @job_nodes a
       join @job_nodes b on b.job_id = a.job_id and b.sort_index = a.sort_index + 1
       where a.job_id in (select id from @runs where status = 'failed')""",
)(_replaced)


def _cascaded(h):
    gone = h.runs.filter("status = 'cancelled'").select("id")
    left = store.delete_cascade(
        h.runs,
        gone,
        "id",
        {
            "run_steps": (h.run_steps, "run_id"),
            "run_events": (h.run_events, "run_id"),
            "queue_item_runs": (h.queue_item_runs, "run_id"),
            "queue_item_step_metadata": (h.queue_item_step_metadata, "run_id"),
        },
    )
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_LEFT = "(select id from @runs where status = 'cancelled')"
query(
    "A11_delete_cascade",
    f"""select 'parent' as table_name, count(*) as rows from @runs where id not in {_LEFT}
        union all select 'run_steps', count(*) from @run_steps where run_id not in {_LEFT}
        union all select 'run_events', count(*) from @run_events where run_id not in {_LEFT}
        union all select 'queue_item_runs', count(*) from @queue_item_runs where run_id not in {_LEFT}
        union all select 'queue_item_step_metadata', count(*) from @queue_item_step_metadata where run_id not in {_LEFT}""",
)(_cascaded)

query(
    "G2_first_definitions",
    """with d as (select job_key, id as listed_at, 'direct' as via from @jobs where display_name <> ''
                 union all
                 select j.job_key, 100 + k.queue_id * 10 + k.sort_index, 'queue ' || k.queue_id
                 from @queue_jobs k join @jobs j on j.id = k.job_id)
       select job_key, arg_min(via, listed_at) as via, min(listed_at) as listed_at from d group by 1""",
)(
    lambda h: store.first_definitions(
        h.jobs.filter("display_name <> ''").select("job_key", F.col("id").alias("listed_at"), F.lit("direct").alias("via")),
        h.queue_jobs.join(h.jobs.select(F.col("id").alias("job_id"), "job_key"), "job_id").select(
            "job_key",
            (100 + F.col("queue_id") * 10 + F.col("sort_index")).alias("listed_at"),
            F.concat(F.lit("queue "), "queue_id").alias("via"),
        ),
    )
)

# Retention as of mid 1999, with the lifecycle end times of the rolled-up items.
RETENTION_NOW, RETENTION_DAYS = "1999-06-30 12:00:00", 400


def retention_of(h, days: int = RETENTION_DAYS):
    ended = counts.item_lifecycle(joins.links_with_runs(h.queue_item_runs, h.runs)).select(
        F.col("queue_item_id").alias("id"), "completed_at"
    )
    items = h.queue_items.join(ended, "id", "left")
    return retention.retention_split(
        h.runs,
        h.run_steps,
        h.run_events,
        items,
        h.queue_item_runs,
        h.queue_item_step_metadata,
        literal_time(RETENTION_NOW),
        days,
    )


_GONE_SQL = f"""
    gone as (select id from @runs where completed_at < timestamp '{RETENTION_NOW}' - interval {RETENTION_DAYS} days
             and status in ('success', 'failed', 'canceled', 'cancelled')),
    ended as (select l.queue_item_id as id, case when not bool_or(lower(trim(r.status)) in ('queued', 'running'))
                     then max(r.completed_at) end as completed_at
              from @queue_item_runs l join @runs r on r.id = l.run_id group by 1),
    gone_items as (select i.id from ended i where i.completed_at < timestamp '{RETENTION_NOW}' - interval {RETENTION_DAYS} days
                   and not exists (select 1 from @queue_item_runs l where l.queue_item_id = i.id
                                   and l.run_id not in (select id from gone)))"""
query("G3_purged_runs", f"with {_GONE_SQL} select id from gone")(lambda h: retention_of(h)["runs"].purged.select("id"))
query("G3_purged_items", f"with {_GONE_SQL} select id from gone_items")(
    lambda h: retention_of(h)["queue_items"].purged.select("id")
)
query(
    "G3_kept_steps",
    f"with {_GONE_SQL} select run_id, step_key from @run_steps where run_id not in (select id from gone)",
)(lambda h: retention_of(h)["run_steps"].kept.select("run_id", "step_key"))
query(
    "G3_kept_links",
    f"""with {_GONE_SQL} select id, queue_item_id, run_id from @queue_item_runs
        where run_id not in (select id from gone) and queue_item_id not in (select id from gone_items)""",
)(lambda h: retention_of(h)["queue_item_runs"].kept.select("id", "queue_item_id", "run_id"))
query(
    "G3_purged_metadata",
    f"""with {_GONE_SQL} select id, queue_item_id, run_id from @queue_item_step_metadata
        where run_id in (select id from gone) or queue_item_id in (select id from gone_items)""",
)(lambda h: retention_of(h)["queue_item_step_metadata"].purged.select("id", "queue_item_id", "run_id"))
query(
    "G3_kept_events",
    f"with {_GONE_SQL} select id, run_id from @run_events where run_id not in (select id from gone)",
)(lambda h: retention_of(h)["run_events"].kept.select("id", "run_id"))


def _by_month(h):
    """The six tables stored by month: runs and items by their own end, what hangs on a run by the run's."""
    ended = counts.item_lifecycle(joins.links_with_runs(h.queue_item_runs, h.runs)).select(F.col("queue_item_id").alias("id"), "completed_at")
    months = h.runs.select(F.col("id").alias("run_id"), monthly.month_of(F.col("completed_at")).alias("month"))
    own = {"runs": h.runs, "queue_items": h.queue_items.join(ended, "id", "left")}
    rows = {name: table.withColumn("month", monthly.month_of(F.col("completed_at"))) for name, table in own.items()}
    for name in ("run_steps", "run_events", "queue_item_runs", "queue_item_step_metadata"):
        rows[name] = getattr(h, name).join(months, "run_id", "left").withColumn("month", F.coalesce("month", F.lit(monthly.OPEN)))
    tables = {name: monthly.MonthlyTable(scratch_path(h.spark, f"monthly-{name}"), table.schema) for name, table in rows.items()}
    for name, table in rows.items():
        tables[name].append(table)
    return tables


def _purged_months(h):
    tables = _by_month(h)
    monthly.purge_months(h.spark, tables, literal_time(RETENTION_NOW), RETENTION_DAYS)
    parts = [table.read(h.spark).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, table in tables.items()]
    return reduce(DataFrame.unionByName, parts)


query(
    "G3_kept_by_month",
    f"""with {_GONE_SQL}
        select 'runs' as table_name, count(*) as rows from @runs where id not in (select id from gone)
        union all select 'queue_items', count(*) from @queue_items where id not in (select id from gone_items)
        union all select 'run_steps', count(*) from @run_steps where run_id not in (select id from gone)
        union all select 'run_events', count(*) from @run_events where run_id not in (select id from gone)
        union all select 'queue_item_runs', count(*) from @queue_item_runs
                  where run_id not in (select id from gone) and queue_item_id not in (select id from gone_items)
        union all select 'queue_item_step_metadata', count(*) from @queue_item_step_metadata
                  where run_id not in (select id from gone) and queue_item_id not in (select id from gone_items)""",
)(_purged_months)


def _deleted_months(h):
    """The runs that were canceled deleted from the months that hold them, with all that hangs on them."""
    tables = _by_month(h)
    gone = materialize(h.runs.filter("status = 'cancelled'").select("id"), "canceled-runs")
    for name in ("run_steps", "run_events", "queue_item_runs", "queue_item_step_metadata"):
        tables[name].remove(gone, "run_id")
    tables["runs"].remove(gone, "id")
    names = {"runs": "parent"}
    parts = [
        table.read(h.spark).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(names.get(name, name)).alias("table_name"), "rows")
        for name, table in tables.items()
        if name != "queue_items"
    ]
    return reduce(DataFrame.unionByName, parts)


query("A11_delete_cascade_by_month", ORACLES["A11_delete_cascade"])(_deleted_months)
query(
    "D15_retention_counts",
    f"""with {_GONE_SQL}
        select 'runs' as table_name, 'purged' as side, count(*) as rows from gone
        union all select 'runs', 'kept', (select count(*) from @runs) - count(*) from gone
        union all select 'queue_items', 'purged', count(*) from gone_items
        union all select 'queue_items', 'kept', (select count(*) from @queue_items) - count(*) from gone_items""",
)(lambda h: retention.retention_counts(retention_of(h)))
query(
    "G4_not_in_registry",
    "select job_key, id from @jobs where job_key not in (select job_key from @schedules where is_enabled and kind = 4)",
)(
    lambda h: store.not_in_registry(h.jobs, h.schedules.filter("is_enabled and kind = 4")).select("job_key", "id")
)
query(
    "G4_synced_catalogue",
    """select j.id, j.job_key, coalesce(s.label, j.display_name) as display_name from @jobs j
       left join (select distinct job_key, 'job ' || job_key as label from @schedules where kind = 4) s using (job_key)""",
)(
    lambda h: store.sync_catalogue(
        h.jobs.select("id", "job_key", "display_name"),
        h.schedules.filter("kind = 4").select(
            F.lit(0).cast("long").alias("id"), "job_key", F.concat(F.lit("job "), "job_key").alias("display_name")
        ).distinct(),
        "job_key",
        keep=["id"],
    )
)
