"""Scalar functions over whole tables (operators H1-H32)."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowledger.catalog.core import query
from flowledger.catalog.sqltext import EFFECTIVE, display, executed, group_of, rank_of, state, trimmed
from flowledger.functions import events as ev
from flowledger.functions import params, status, text, times

_SCHEDULER = "lower(trim(triggered_by)) like 'scheduler:%'"

for _name, _fn, _sql in (
    ("H1_exec_status", status.exec_status, executed("status")),
    ("H3_display_status", status.display_status, display("status")),
    ("H4_timeline_state", status.timeline_state, state("status")),
    (
        "H5_queue_status",
        status.queue_status,
        f"case when {trimmed('status')} in ('complete', 'completed', 'success') then 'complete' "
        f"when {trimmed('status')} in ('failed', 'canceled', 'cancelled') then 'failed' "
        f"when {trimmed('status')} in ('running', 'in_progress') then 'running' "
        f"when {trimmed('status')} in ('queued', 'not_started', 'todo') then 'queued' else 'pending' end",
    ),
    ("H6_step_group", status.step_group, group_of("status")),
    (
        "H7_step_visual_state",
        status.step_visual_state,
        f"case when {display('status')} in ('failed', 'canceled') then 'failed' when {display('status')} = 'running' "
        f"then 'running' when {display('status')} = 'success' then 'succeeded' when {display('status')} = 'skipped' "
        f"then 'executed' else 'not-executed' end",
    ),
    ("H8_status_rank", status.status_rank, f"cast({rank_of('status')} as bigint)"),
):
    query(_name, f"select id, status, {_sql} as result from @spellings")(
        lambda h, f=_fn: h.spellings.select("id", "status", f(F.col("status")).alias("result"))
    )
query("H2_terminal", f"select id, {executed('status')} in ('success', 'failed', 'canceled') as terminal from @spellings")(
    lambda h: h.spellings.select("id", status.is_terminal(F.col("status")).alias("terminal"))
)
query("H9_non_empty", "select id, coalesce(nullif(trim(status), ''), 'fallback') as result from @spellings")(
    lambda h: h.spellings.select("id", text.non_empty(F.col("status"), F.lit("fallback")).alias("result"))
)
query(
    "H11_slug",
    """select p_partkey, case when trim(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '_') = ''
       then 'schedule' else trim(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '_') end as slug
       from @part""",
)(lambda h: h.part.select("p_partkey", text.slug(F.lower(F.concat_ws("/", "p_name", "p_type"))).alias("slug")))
query(
    "H12_truncate",
    f"""select page_id, case when length(html) <= {ev.MAX_MESSAGE} then html else left(html, {ev.MAX_MESSAGE})
        || '… (' || (length(html) - {ev.MAX_MESSAGE}) || ' chars truncated)' end as body from @pages""",
)(lambda h: h.pages.select("page_id", text.truncate_note(F.col("html"), ev.MAX_MESSAGE).alias("body")))
query(
    "H13_severity",
    """select id, case when lower(trim(level)) in ('error', 'fatal') or lower(event_type) like '%fail%'
                         or lower(event_type) like '%error%' then 'error'
                    when lower(trim(level)) in ('warn', 'warning') or lower(event_type) like '%warn%' then 'warning'
                    else '' end as severity from @run_events""",
)(lambda h: h.run_events.select("id", ev.severity(F.col("level"), F.col("event_type")).alias("severity")))
query(
    "H14_event_classes",
    """select id, case event_type when 'step_succeeded' then 'step-succeeded' when 'step_failed' then 'step-failed'
              else '' end as outcome, lower(trim(level)) as level,
              case when id % 15 - 5 >= 8 then 'error' when id % 15 - 5 >= 4 then 'warn' when id % 15 - 5 >= 0 then 'info'
              else 'debug' end as from_number,
              case when step_key = '' then 'step log' else step_key end as message from @run_events""",
)(
    lambda h: h.run_events.select(
        "id",
        ev.outcome_class(F.col("event_type")).alias("outcome"),
        ev.event_level(F.col("level")).alias("level"),
        ev.level_name(F.col("id") % 15 - 5).alias("from_number"),
        ev.log_message(F.concat(F.lit(" "), "step_key", F.lit("\t"))).alias("message"),
    )
)
query(
    "H15_stored_time",
    """select id, raw, case when raw = '' or raw like 'yesterday%' then null
                   else timezone('UTC', cast(regexp_replace(raw, '([.][0-9]{6})[0-9]+', '\\1') as timestamptz)) end as at
       from @time_texts""",
)(lambda h: h.time_texts.select("id", "raw", times.stored_time(F.col("raw")).alias("at")))
query("H16_effective_time", f"select id, {EFFECTIVE} as ts from @runs")(
    lambda h: h.runs.select(
        "id", times.effective_time(F.col("started_at"), F.col("queued_at"), F.col("completed_at")).alias("ts")
    )
)
query("H17_start_time", "select id, coalesce(started_at, queued_at) as ts from @runs")(
    lambda h: h.runs.select(
        "id", times.start_time(F.col("started_at"), F.col("queued_at"), F.col("completed_at")).alias("ts")
    )
)
query(
    "H18_duration",
    "select id, case when completed_at > started_at then epoch_ms(completed_at) - epoch_ms(started_at) else 0 end as ms"
    " from @runs",
)(lambda h: h.runs.select("id", times.duration_ms(F.col("started_at"), F.col("completed_at")).alias("ms")))
query(
    "H19_step_duration",
    """select run_id, step_key, case when status <> 'failed' and duration_ms > 0 then duration_ms
         when started_at is null then 0
         else greatest(0, epoch_ms(timestamp '1999-01-01') - epoch_ms(started_at)) end as ms from @run_steps""",
)(
    lambda h: h.run_steps.select(
        "run_id",
        "step_key",
        times.step_duration_ms(
            F.when(F.col("status") == "failed", F.lit(0).cast("long")).otherwise(F.col("duration_ms")),
            F.col("started_at"),
            times.literal_time("1999-01-01 00:00:00"),
        ).alias("ms"),
    )
)
query(
    "H20_live_duration",
    f"""select id, case when completed_at > started_at then epoch_ms(completed_at) - epoch_ms(started_at)
            when {state('status')} = 'running' and timestamp '2001-08-01' > coalesce(started_at, queued_at)
                 then epoch_ms(timestamp '2001-08-01') - epoch_ms(coalesce(started_at, queued_at)) else 0 end as ms
        from @runs""",
)(
    lambda h: h.runs.select(
        "id",
        times.live_duration_ms(
            F.lit(0).cast("long"),
            times.start_time(F.col("started_at"), F.col("queued_at"), F.col("completed_at")),
            F.col("completed_at"),
            status.timeline_state(F.col("status")),
            times.literal_time("2001-08-01 00:00:00"),
        ).alias("ms"),
    )
)
query(
    "H21_timeline_time",
    f"select id, case when {_SCHEDULER} then date_trunc('minute', {EFFECTIVE}) else {EFFECTIVE} end as ts from @runs",
)(
    lambda h: h.runs.select(
        "id",
        times.timeline_time(F.col("triggered_by"), F.col("started_at"), F.col("queued_at"), F.col("completed_at")).alias(
            "ts"
        ),
    )
)
query("H22_retention_cutoff", "select id, queued_at - interval 30 days as cutoff from @runs")(
    lambda h: h.runs.select("id", times.retention_cutoff(F.col("queued_at"), 30).alias("cutoff"))
)
query(
    "H23_overview_window",
    """select id, queued_at - interval 270 minutes as window_start, queued_at + interval 90 minutes as window_end,
              queued_at + interval 91 minutes as render_end from @runs""",
)(
    lambda h: h.runs.select(
        "id",
        *[
            c.alias(n)
            for c, n in zip(times.overview_window(F.col("queued_at"), 6), ("window_start", "window_end", "render_end"))
        ],
    )
)
query(
    "H24_queue_params",
    """select i.id, '{"workflow_queue":{"external_key":"' || i.external_key || '","partition_key":"' || i.partition_key
              || '","payload":' || cast(json(i.payload_json) as varchar) || ',"queue_item_id":' || i.id
              || ',"queue_key":"' || q.queue_key || '"}}' as params
       from @queue_items i join @queues q on q.id = i.queue_id""",
)(
    lambda h: h.queue_items.join(h.queues.select(F.col("id").alias("queue_id"), "queue_key"), "queue_id").select(
        "id",
        params.queue_params(
            F.col("queue_key"),
            F.col("id"),
            F.concat(F.lit(" "), "partition_key"),
            F.col("external_key"),
            F.col("payload_json"),
        ).alias("params"),
    )
)
query(
    "H24_scheduled_and_note_params",
    """select id, '{"schedule_key":"s' || job_id || '","scheduled_for":"' || strftime(queued_at, '%Y-%m-%dT%H:%M:%S')
              || 'Z","scheduler_key":"main"}' as scheduled,
              case when error_message = '' then '{}' else '{"note":"' || error_message || '"}' end as note from @runs""",
)(
    lambda h: h.runs.select(
        "id",
        params.scheduled_params(F.col("queued_at"), F.concat(F.lit("s"), "job_id"), F.lit("main")).alias("scheduled"),
        params.note_params(F.concat("error_message", F.lit("  "))).alias("note"),
    )
)
query(
    "H24_event_payload",
    """select id, '{"parent_run_id":"' || parent_run_id || '","queue":"q' || job_id || '","triggered_by":"override"}' as payload
       from @runs""",
)(
    lambda h: h.runs.select(
        "id",
        params.payload_json(
            params.merge_payload(
                F.create_map(
                    F.lit("triggered_by"), F.col("triggered_by"), F.lit("parent_run_id"), F.col("parent_run_id").cast("string")
                ),
                F.create_map(F.lit("triggered_by"), F.lit("override"), F.lit("queue"), F.concat(F.lit("q"), "job_id")),
            )
        ).alias("payload"),
    )
)
query(
    "H25_queue_meta",
    """select id, json_extract_string(params_json, '$.workflow_queue.queue_key') as queue_key,
              cast(json_extract_string(params_json, '$.workflow_queue.queue_item_id') as bigint) as queue_item_id,
              json_extract_string(params_json, '$.workflow_queue.partition_key') as partition_key,
              json_extract_string(params_json, '$.workflow_queue.external_key') as external_key,
              cast(json_extract(params_json, '$.workflow_queue.payload') as varchar) as payload_json,
              case when json_extract_string(params_json, '$.workflow_queue.partition_key') = ''
                   then 'queue params are incomplete' else '' end as error
       from @runs where params_json <> '{}'""",
)(
    lambda h: h.runs.select("id", params.queue_meta(F.col("params_json")).alias("meta"))
    .filter("meta is not null")
    .select("id", "meta.*")
)
_PROPS = StructType([StructField("k", LongType()), StructField("missing", StringType())])
query(
    "H26_payload_round_trip",
    """select id, cast(json_extract_string(payload_json, '$.k') as bigint) as k,
              '{"k":' || json_extract_string(payload_json, '$.k') || '}' as payload from @queue_items""",
)(
    lambda h: h.queue_items.select("id", params.payload_struct(F.col("payload_json"), _PROPS).alias("p")).select(
        "id", "p.k", F.to_json("p").alias("payload")
    )
)
query(
    "H27_partition_key",
    "select id, nullif(trim(status), '') as partition_key, trim(status) = '' as rejected from @spellings",
)(
    lambda h: h.spellings.select(
        "id",
        params.partition_key(F.col("status")).alias("partition_key"),
        params.partition_key(F.col("status")).isNull().alias("rejected"),
    )
)


def _attributes(h):
    rows = h.run_events.select(
        "id",
        F.struct(
            F.struct(F.col("run_id").alias("id"), F.struct("level").alias("log")).alias("run"),
            F.col("event_type").alias("kind"),
            F.date_trunc("second", "created_at").alias("at"),
        ).alias("attrs"),
    )
    dtype = rows.schema["attrs"].dataType
    return rows.select("id", F.explode(params.attribute_map(F.col("attrs"), dtype)))


query(
    "H28_flat_attributes",
    """select id, 'run.id' as key, cast(run_id as varchar) as value from @run_events
       union all select id, 'run.log.level', level from @run_events
       union all select id, 'kind', event_type from @run_events
       union all select id, 'at', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') from @run_events""",
)(_attributes)
query("H30_label", "select id, coalesce(nullif(display_name, ''), job_key) as label from @jobs")(
    lambda h: h.jobs.select("id", text.label(F.col("display_name"), F.col("job_key")).alias("label"))
)
query(
    "H31_same_words",
    """select o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g'))
              = trim(regexp_replace(lower('2 high!'), '[^a-z0-9]+', ' ', 'g')) as same from @orders""",
)(
    lambda h: h.orders.select("o_orderkey", text.same_words(F.col("o_orderpriority"), F.lit("2 high!")).alias("same"))
)
query(
    "H32_trigger_origin",
    """select split_part(triggered_by, ':', 1) as origin, split_part(triggered_by, ':', 2) as key, count(*) as runs
       from @runs group by 1, 2""",
)(
    lambda h: h.runs.select(params.trigger_origin(F.col("triggered_by")).alias("t"))
    .groupBy("t.origin", "t.key")
    .agg(F.count(F.lit(1)).alias("runs"))
)
