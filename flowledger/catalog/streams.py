"""Streams run to the end of their input (operators A2, A3, K1-K8); results equal the batch answer."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from flowledger.catalog.core import query
from flowledger.catalog.counted import LIFECYCLE_SQL
from flowledger.functions.status import exec_status
from flowledger.functions.times import literal_time
from flowledger.operators.calendars import tasks
from flowledger.session import scratch_path
from flowledger.sources.derived import History
from flowledger.streaming import fold, ingest, item_status, run_fold, sinks, ticks

EVENTS = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ]
)
NOW = "2024-02-01 00:00:00"


def _streamed(h: History) -> History:
    """The derived tables over a stream of the events file."""
    live = History(h.spark, h.folder)
    live._built["events"] = sinks.table_stream(h.spark, EVENTS, h.folder, files="events.parquet")
    return live


def _as_stream(rows: DataFrame, files: int = 3) -> DataFrame:
    """Rows written as a few files and streamed one file per micro-batch."""
    path = scratch_path(rows.sparkSession, "stream-input")
    rows.repartition(files).write.parquet(path)
    return sinks.table_stream(rows.sparkSession, rows.schema, path, files_per_batch=1)


def _drain(h: History, rows: DataFrame, on_batch, mode: str = "append") -> None:
    sinks.run_stream(rows, scratch_path(h.spark, "stream-state"), on_batch, mode=mode).awaitTermination()


def _folded(h: History, rows: DataFrame, *keys: str) -> DataFrame:
    sink = sinks.BatchSink(scratch_path(h.spark, "fold"))
    _drain(h, rows, fold.updates_to(sink, "rows"), mode="update")
    return sink.latest(h.spark, "rows", rows.schema, *keys)


def _appended(h: History, rows: DataFrame) -> DataFrame:
    sink = sinks.BatchSink(scratch_path(h.spark, "append"))
    _drain(h, rows, fold.updates_to(sink, "rows"))
    return sink.read(h.spark, "rows", rows.schema).drop("batch")


query("A2_poll_source", "select id, run_id, event_type, created_at from @run_events")(
    lambda h: _appended(h, _streamed(h).run_events.select("id", "run_id", "event_type", "created_at"))
)
query("A3_stream_source", "select id, queue_id, partition_key from @queue_items")(
    lambda h: _appended(h, _as_stream(h.queue_items.select("id", "queue_id", "partition_key")))
)


#: The ingestion of a folder runs once in a session; its tables are read from there.
_ingestions: dict[tuple[str, str], sinks.BatchSink] = {}


def _ingested(h: History, table: str) -> DataFrame:
    key = (h.spark.sparkContext.applicationId, h.folder)
    if key not in _ingestions:
        _ingestions[key] = _ingest(h)
    sink = _ingestions[key]
    schema = h.spark.read.parquet(f"{sink.folder}/{table}/batch=0").schema
    return sink.read(h.spark, table, schema).drop("batch")


def _ingest(h: History) -> sinks.BatchSink:
    arrivals = _streamed(h).queue_items.select(
        "queue_id",
        F.concat(F.lit("q"), "queue_id").alias("queue_key"),
        F.col("id").cast("string").alias("source_key"),
        F.concat(F.lit(" "), "external_key").alias("external_key"),
        F.when(F.col("id") % 97 == 0, F.lit("{oops")).otherwise(F.col("payload_json")).alias("payload_json"),
        F.when(F.col("id") % 2 == 0, F.col("queued_at")).alias("queued_at"),
        F.when(F.col("id") % 31 == 0, F.lit(" ")).otherwise(F.col("partition_key")).alias("raw_key"),
    )
    sink = sinks.BatchSink(scratch_path(h.spark, "ingest"))
    on_batch = ingest.ingest_batches(
        sink, F.col("raw_key"), literal_time(NOW), F.col("source_key").cast("long"), h.queue_jobs, h.job_nodes
    )
    _drain(h, arrivals, on_batch)
    return sink


_ITEMS_SQL = f"""
    a as (select id, queue_id, 'q' || queue_id as queue_key, id % 97 = 0 as unreadable, id % 31 = 0 as no_key,
                 exists (select 1 from @queue_jobs k where k.queue_id = i.queue_id
                         and k.job_id not in (select job_id from @job_nodes)) as broken,
                 partition_key, external_key, payload_json,
                 case when id % 2 = 0 then queued_at else timestamp '{NOW}' end as queued_at
          from @queue_items i),
    ok as (select *, 'qit_' || sha256(queue_key || chr(0) || id) as queue_item_key from a
           where not unreadable and not no_key and not broken)"""
query(
    "K1_ingested_items",
    f"""with {_ITEMS_SQL} select queue_item_key, queue_id, queue_key, partition_key, 'queued' as status, external_key,
            payload_json, '' as error_message, queued_at, cast(id as varchar) as source_key from ok""",
)(lambda h: _ingested(h, "items"))
query(
    "K1_rejected_arrivals",
    f"""with {_ITEMS_SQL} select cast(id as varchar) as source_key, case when unreadable then 'payload is not valid json'
            when no_key then 'partition key is required' else 'job has no nodes' end as error
        from a where unreadable or no_key or broken""",
)(lambda h: _ingested(h, "rejected"))
_RUNS_SQL = f"""
    {_ITEMS_SQL},
    r as (select ok.*, k.job_id, 'run_' || sha256(ok.queue_item_key || chr(0) || k.job_id) as run_key
          from ok join @queue_jobs k on k.queue_id = ok.queue_id)"""
query(
    "K2_fanned_out_runs",
    f"""with {_RUNS_SQL}
        select run_key, job_id, 'queued' as status, 'queue:' || queue_key as triggered_by,
               '{{"workflow_queue":{{"external_key":"' || external_key || '","partition_key":"' || partition_key
               || '","payload":' || cast(json(payload_json) as varchar) || ',"queue_item_id":' || id
               || ',"queue_key":"' || queue_key || '"}}}}' as params_json, queued_at,
               cast(0 as bigint) as parent_run_id, '' as rerun_step_key, '' as error_message from r""",
)(lambda h: _ingested(h, "runs"))
query("K2_fanned_out_links", f"with {_RUNS_SQL} select queue_item_key, job_id, run_key from r")(
    lambda h: _ingested(h, "links")
)
query(
    "K2_fanned_out_events",
    f"""with {_RUNS_SQL}
        select run_key, '' as step_key, 'run_queued' as event_type, 'info' as level, 'run queued' as message,
               '{{"external_key":"' || external_key || '","parent_run_id":"0","partition_key":"' || partition_key
               || '","queue_item_id":"' || id || '","queue_key":"' || queue_key
               || '","rerun_step_key":"","triggered_by":"queue:' || queue_key || '"}}' as event_data_json from r""",
)(lambda h: _ingested(h, "events"))
query(
    "K2_fanned_out_steps",
    f"with {_RUNS_SQL} select r.run_key, n.step_key from r join @job_nodes n on n.job_id = r.job_id",
)(lambda h: _ingested(h, "steps").select("run_key", "step_key"))


def _run_changes(h: History) -> DataFrame:
    """Every run is queued first, then takes its stored state."""
    now = h.runs.select(
        F.col("id").alias("run_id"), F.col("id") * 2 + 1, exec_status(F.col("status")), "started_at", "completed_at",
        "error_message",
    )
    names = ["run_id", "change_id", "status", "started_at", "completed_at", "error_message"]
    queued = h.runs.select(
        F.col("id").alias("run_id"), F.col("id") * 2, F.lit("queued"), F.lit(None).cast("timestamp"),
        F.lit(None).cast("timestamp"), F.lit(""),
    )
    return queued.toDF(*names).unionByName(now.toDF(*names))


_ITEM_STATUS = StructType(
    [
        StructField("queue_item_id", LongType()),
        StructField("status", StringType()),
        StructField("started_at", TimestampType()),
        StructField("completed_at", TimestampType()),
        StructField("error_message", StringType()),
    ]
)


def _in_turn(rows: DataFrame, part: Column, files: int = 3) -> DataFrame:
    """Rows streamed in about as many micro-batches as there are parts, in order of ``part`` (0, 1, ...); each task writes a file of a part."""
    spark = rows.sparkSession
    path, width = scratch_path(spark, "stream-input"), tasks(spark)
    for i in range(files):
        rows.filter(part == i).repartition(width, "run_id").write.mode("append").parquet(path)
    return sinks.table_stream(spark, rows.schema, path, files_per_batch=width)


def _item_status(h: History) -> DataFrame:
    """A third of the links comes with the first states, a third with the last ones, a third after them."""
    sink = sinks.BatchSink(scratch_path(h.spark, "item-status"))
    changes = _in_turn(_run_changes(h), F.col("change_id") % 2, files=2)
    links = _in_turn(h.queue_item_runs, F.col("id") % 3)
    item_status.sync_item_status(changes, links, sink, scratch_path(h.spark, "stream-state")).awaitTermination()
    return sink.latest(h.spark, item_status.TABLE, _ITEM_STATUS, "queue_item_id")


query("K3_item_status", LIFECYCLE_SQL)(_item_status)


def _grown_items(h: History) -> DataFrame:
    """Streams of part of the links first; a second start from the same state brings the others, so items grow across it."""
    sink, state = sinks.BatchSink(scratch_path(h.spark, "item-status")), scratch_path(h.spark, "stream-state")
    paths = [scratch_path(h.spark, "stream-input") for _ in range(2)]
    for part in range(2):
        h.queue_item_runs.filter(F.col("id") % 2 == part).write.mode("append").parquet(paths[0])
        _run_changes(h).filter(F.col("change_id") % 2 == part).write.mode("append").parquet(paths[1])
        links, changes = (
            sinks.table_stream(h.spark, rows.schema, path) for rows, path in zip((h.queue_item_runs, _run_changes(h)), paths, strict=True)
        )
        item_status.sync_item_status(changes, links, sink, state).awaitTermination()
    return sink.latest(h.spark, item_status.TABLE, _ITEM_STATUS, "queue_item_id")


query("K3_item_status_of_wide_items", LIFECYCLE_SQL)(_grown_items)


def _published(h: History) -> DataFrame:
    return h.queue_item_step_metadata.withColumns(
        {
            "status": F.when(F.col("run_id") % 9 == 0, F.lit("failed")).otherwise(F.lit("success")),
            "metadata_json": F.when(F.col("run_id") % 7 == 0, F.lit("{}")).otherwise(F.col("metadata_json")),
        }
    )


query(
    "K4_latest_metadata",
    """select queue_item_id, job_id, step_key, arg_max(run_id, id) as run_id, arg_max(metadata_json, id) as metadata_json
       from @queue_item_step_metadata where run_id % 9 <> 0 and run_id % 7 <> 0 group by 1, 2, 3""",
)(lambda h: _folded(h, fold.latest_metadata(_as_stream(_published(h))), "queue_item_id", "job_id", "step_key"))

_RUN_STATES_SQL = """with m as (select *, case event_type when 'run_started' then 'running'
                         else json_extract_string(event_data_json, '$.status') end as state
                  from @run_events where step_key = '')
       select run_id, coalesce(arg_min(state, id) filter (where event_type = 'run_completed'), arg_max(state, id)) as status,
              min(created_at) filter (where event_type = 'run_started') as started_at,
              arg_min(created_at, id) filter (where event_type = 'run_completed') as completed_at
       from m group by 1"""
query("K5_run_states", _RUN_STATES_SQL)(lambda h: _folded(h, fold.run_states(_as_stream(h.run_events)), "run_id"))
_STEP_STATES_SQL = """select run_id, step_key, arg_max(case event_type when 'step_started' then 'running' when 'step_failed' then 'failed'
                                         else 'success' end, id) as status,
              min(created_at) filter (where event_type = 'step_started') as started_at,
              max(created_at) filter (where event_type <> 'step_started') as completed_at
       from @run_events where step_key <> '' group by 1, 2"""
query("K5_step_states", _STEP_STATES_SQL)(lambda h: _folded(h, fold.step_states(_as_stream(h.run_events)), "run_id", "step_key"))


def _bounded_fold(h: History) -> DataFrame:
    """Entries of all events, a third of the days per micro-batch, with the state of runs dropped a day after their end."""
    path = scratch_path(h.spark, "stream-input")
    days = h.run_events.agg(F.min("created_at").alias("first"), (F.datediff(F.max("created_at"), F.min("created_at")) + 1).alias("days")).first()
    part = F.floor(F.datediff("created_at", F.lit(days["first"])) * 3 / F.lit(days["days"] or 1))
    for nth in range(3):  # file streams take older files first
        h.run_events.filter(part == nth).coalesce(1).write.mode("append").parquet(path)
    sink = sinks.BatchSink(scratch_path(h.spark, "run-fold"))
    source = sinks.table_stream(h.spark, h.run_events.schema, path, files_per_batch=1)
    run_fold.sync_run_states(source, sink, scratch_path(h.spark, "stream-state")).awaitTermination()
    return run_fold.read_entries(h.spark, sink)


query("K5_run_states_with_bounded_state", _RUN_STATES_SQL)(lambda h: run_fold.run_states(_bounded_fold(h)))
query("K5_step_states_with_bounded_state", _STEP_STATES_SQL)(lambda h: run_fold.step_states(_bounded_fold(h)))


def _tick_arrivals(h: History) -> DataFrame:
    """Each event offers its minute as a tick of its user's schedule, many of them more than once."""
    return h.events.select(
        F.concat(F.lit("job_"), F.col("user_id") % 7).alias("job_key"),
        F.col("event_type").alias("schedule_key"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("scheduled_for"),
    )


query(
    "K6_first_claims",
    """select distinct 'job_' || (user_id % 7) as job_key, event_type as schedule_key,
              cast(date_trunc('day', ts) as timestamp) as scheduled_for from @events""",
)(lambda h: _appended(h, ticks.first_claims(_as_stream(_tick_arrivals(h)), keep_for="60 days")))
query(
    "K7_on_time_ticks",
    """select id, created_at as scheduled_for from @run_events
       where created_at > timestamp '2024-01-15 12:00:00' - interval 6 hours and created_at <= timestamp '2024-01-15 12:00:00'""",
)(
    lambda h: _appended(
        h,
        ticks.on_time(
            _streamed(h).run_events.select("id", F.col("created_at").alias("scheduled_for")),
            literal_time("2024-01-15 12:00:00"),
            tick_seconds=6 * 3600,
        ),
    )
)
query(
    "K8_heartbeats",
    f"""select scheduler_key, max(last_heartbeat_at) as last_heartbeat_at,
               arg_max_null(last_tick_started_at, last_heartbeat_at) as last_tick_started_at,
               arg_max_null(last_tick_completed_at, last_heartbeat_at) as last_tick_completed_at,
               arg_max_null(last_error, last_heartbeat_at) as last_error,
               cast(epoch(timestamp '{NOW}') as bigint) - cast(floor(epoch(max(last_heartbeat_at))) as bigint) as age_seconds
        from @heartbeats group by 1""",
)(
    lambda h: fold.heartbeat_age(
        _folded(h, fold.latest_heartbeats(_as_stream(h.heartbeats)), "scheduler_key"), literal_time(NOW)
    )
)
