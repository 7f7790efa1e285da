"""Literal cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowledger.functions import cron, params, status, text, times
from flowledger.operators import contracts, content, counts, execution, graph, retention, schedules, steps, store
from flowledger.plans import tick, timeline
from flowledger.sources.tables import typed_times


def at(value):
    return dt.datetime.fromisoformat(value)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


LIFECYCLE = (
    "queue_item_id long, id long, created_at timestamp, run_status string, started_at timestamp, "
    "completed_at timestamp, run_error_message string"
)


def minute(m):
    return None if m is None else dt.datetime(2026, 3, 1, 12, m)


@pytest.mark.parametrize(
    "runs, expected",
    [
        ([("queued", None, None, ""), ("queued", None, None, "")], ("queued", None, None, "")),
        ([("running", 5, None, ""), ("queued", None, None, ""), ("running", 2, None, "")], ("running", 2, None, "")),
        ([("success", 1, 3, ""), ("success", 2, 7, "ignored")], ("complete", 1, 7, "")),
        (
            [("success", 1, 2, ""), ("failed", 3, 8, "boom"), ("cancelled", 4, 9, "later")],
            ("failed", 1, 9, "boom"),
        ),
    ],
)
def test_item_lifecycle(spark, runs, expected):
    data = [(1, i, minute(i), s, minute(a), minute(b), e) for i, (s, a, b, e) in enumerate(runs)]
    got = counts.item_lifecycle(spark.createDataFrame(data, LIFECYCLE)).first()
    assert tuple(got)[1:] == (expected[0], minute(expected[1]), minute(expected[2]), expected[3])


@pytest.fixture(scope="module")
def history(spark):
    now = at("2026-03-25T12:00:00")

    def ago(days):
        return now - dt.timedelta(days=days)

    runs = spark.createDataFrame(
        [(1, "success", ago(40)), (2, "success", ago(5)), (3, "running", None)],
        "id long, status string, completed_at timestamp",
    )
    children = "run_id long, step_key string"
    items = spark.createDataFrame([(10, ago(40)), (11, ago(40))], "id long, completed_at timestamp")
    links = spark.createDataFrame(
        [(100, 10, 1), (101, 11, 1), (102, 11, 2)], "id long, queue_item_id long, run_id long"
    )
    return dict(
        runs=runs,
        steps=spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], children),
        events=spark.createDataFrame([(1, ""), (2, ""), (3, "")], children),
        items=items,
        links=links,
        metadata=links,
        now=F.lit(now),
    )


def test_retention_purges_runs_then_items(history):
    split = retention.retention_split(**history, days=30)
    assert rows(split["runs"].purged, "id") == [(1,)]
    assert rows(split["queue_items"].purged, "id") == [(10,)]
    assert rows(split["run_steps"].kept, "run_id") == [(2,), (3,)]
    assert rows(split["run_events"].purged, "run_id") == [(1,)]
    # The item shared with a recent run stays, with that run's link and metadata only.
    assert rows(split["queue_item_runs"].kept, "id") == [(102,)]
    assert rows(split["queue_item_step_metadata"].purged, "id") == [(100,), (101,)]


def test_retention_of_zero_days_changes_nothing(history):
    split = retention.retention_split(**history, days=0)
    assert all(side.purged.isEmpty() for side in split.values())
    assert split["runs"].kept.count() == 3 and split["queue_item_runs"].kept.count() == 3


def schedule(spark, *crons, zone="UTC"):
    data = [("job", f"s{i}", c, zone, True, i) for i, c in enumerate(crons)]
    return spark.createDataFrame(
        data, "job_key string, schedule_key string, cron_expr string, timezone string, is_enabled boolean, sort_index long"
    )


def ticks(spark, expr, start, end, zone="UTC", cap=None):
    found = schedules.occurrences(
        schedule(spark, expr, zone=zone), times.literal_time(start), times.literal_time(end), cap=cap
    )
    return sorted(t.strftime("%d %H:%M") for (t,) in rows(found, "tick"))


def test_occurrences(spark):
    assert ticks(spark, "*/5 * * * *", "2026-03-01 18:00", "2026-03-01 18:15") == ["01 18:05", "01 18:10", "01 18:15"]
    assert ticks(spark, "* * * * *", "2026-03-01 18:00", "2026-03-01 19:00", cap=5) == [
        f"01 18:0{m}" for m in range(1, 6)
    ]
    assert ticks(spark, "0 0 * * 5-7", "2026-03-01 00:00", "2026-04-01 00:00") == []
    assert ticks(spark, "0 0 *", "2026-03-01 00:00", "2026-04-01 00:00") == []
    assert ticks(spark, "0 0 1 * 7", "2026-03-01 12:00", "2026-03-09 00:00") == ["08 00:00"]


def test_occurrences_over_clock_changes(spark):
    zone = "America/New_York"
    # 02:30 does not exist on 8 March 2026 and 01:30 happens twice on 1 November.
    assert ticks(spark, "30 2 * * *", "2026-03-07 00:00", "2026-03-10 00:00", zone) == ["07 07:30", "09 06:30"]
    assert ticks(spark, "30 1 * * *", "2026-11-01 00:00", "2026-11-02 00:00", zone) == ["01 05:30", "01 06:30"]


def state(spark, last=None):
    return spark.createDataFrame(
        [("job", "s0", at("2026-03-01T00:00:00"), last)],
        "job_key string, schedule_key string, last_checked_at timestamp, last_enqueued_at timestamp",
    )


@pytest.mark.parametrize(
    "expr, now, last, expected",
    [
        ("* * * * *", "2026-03-01 18:06:02", None, ["18:06"]),
        ("*/5 * * * *", "2026-03-01 21:27:08", None, []),
        ("*/5 * * * *", "2026-03-01 21:30:02", None, ["21:30"]),
        ("* * * * *", "2026-03-01 18:06:02", "2026-03-01T18:06:00", []),
    ],
)
def test_due_ticks(spark, expr, now, last, expected):
    due = schedules.due_ticks(schedule(spark, expr), state(spark, last and at(last)), times.literal_time(now))
    assert [t.strftime("%H:%M") for (t,) in rows(due, "tick")] == expected


def test_next_run_may_be_years_away(spark):
    found = schedules.next_ticks(schedule(spark, "0 0 29 2 *", "0 0 30 2 *"), times.literal_time("2025-01-01 00:00:00"))
    assert rows(found, "schedule_key", "next_run_at") == [("s0", at("2028-02-29T00:00:00"))]


def test_capped_due_ticks_set_the_next_run_after_the_last_kept(spark):
    now = times.literal_time("2026-03-01 18:10:00")
    declared = schedule(spark, "* * * * *")
    due = schedules.due_ticks(declared, state(spark), now, tick_seconds=600, max_due=3)
    assert sorted(t.minute for (t,) in rows(due, "tick")) == [1, 2, 3]
    assert rows(schedules.next_runs(declared, due, now, max_due=3), "next_run_at") == [(at("2026-03-01T18:04:00"),)]


def test_a_moment_is_claimed_once(spark):
    due = schedules.due_ticks(schedule(spark, "* * * * *"), state(spark), times.literal_time("2026-03-01 18:06:02"))
    none = spark.createDataFrame([], "job_key string, schedule_key string, scheduled_for timestamp")
    won = tick.claim(due, none)
    assert won.count() == 1
    assert tick.claim(due, won).count() == 0


RUN = (
    "id long, run_key string, job_key string, status string, triggered_by string, queued_at timestamp, "
    "started_at timestamp, completed_at timestamp"
)


@pytest.mark.parametrize("now, expected", [("10:34:00", ["35", "40", "45"]), ("10:36:00", ["40", "45"])])
def test_timeline_markers(spark, now, expected):
    runs = spark.createDataFrame([], RUN)
    day = "2026-03-01 "
    found = timeline.timeline(
        runs, schedule(spark, "*/5 * * * *"), *[times.literal_time(day + t) for t in (now, "10:30:00", "10:45:00")]
    )
    assert sorted(t.strftime("%M") for (t,) in rows(found.filter("state = 'will_run'"), "ts")) == expected


def test_a_scheduled_run_replaces_its_marker(spark):
    day = "2026-03-01T"
    runs = spark.createDataFrame(
        [
            (1, "run_1", "job", "running", " Scheduler:s0", at(day + "10:40:02"), at(day + "10:40:26"), None),
            (2, "run_2", "job", "success", "scheduler:s0", at(day + "10:35:20"), at(day + "10:35:22"), at(day + "10:35:55")),
        ],
        RUN,
    )
    found = timeline.timeline(
        runs,
        schedule(spark, "*/5 * * * *"),
        *[times.literal_time(f"2026-03-01 {t}") for t in ("10:34:00", "10:30:00", "10:45:00")],
    )
    assert [(r.ts.strftime("%M"), r.state) for r in found.orderBy("ts", "id").collect()] == [
        ("35", "succeeded"), ("40", "running"), ("45", "will_run"),
    ]


@pytest.mark.parametrize(
    "expr, key",
    [
        ("*/15 * * * *", "every_15_minutes"), ("0 * * * *", "hourly"), ("5 * * * *", "hourly_at_05"),
        ("* * * * *", "every_minute"), ("7 */3 * * *", "every_3_hours_at_07"), ("0 0 * * *", "daily"),
        ("30 9 * * *", "daily_at_09_30"), ("0 9 * * MON", "weekly_on_mon_at_09_00"), ("0 9 * * 7", "weekly_on_sun_at_09_00"),
        ("0 0 1 * *", "monthly"), ("0 6 15 * *", "monthly_on_15_at_06_00"), ("@Daily", "daily"), ("", "schedule"),
        ("*/x * * * *", "cron_x"), ("0 9 * * mon-fri", "cron_0_9_mon_fri"), ("0 0 *", "cron_0_0"), ("***", "cron_schedule"),
    ],
)
def test_inferred_schedule_key(spark, expr, key):
    assert spark.range(1).select(cron.schedule_key(F.lit(expr))).first()[0] == key


@pytest.mark.parametrize(
    "expr, valid",
    [
        ("0 0 * * sun,6", True), ("0 0 1-5/2 jan-mar *", True), ("60 * * * *", False), ("*/0 * * * *", False),
        ("1-2-3 * * * *", False), ("5/10 * * * *", True), ("0 0 0 * *", False), ("a * * * *", False),
        ("5-1 * * * *", False), ("*/2/2 * * * *", False), (", * * * *", False), ("0 0 * * 7", True), ("@hourly", True),
    ],
)
def test_cron_validity(spark, expr, valid):
    assert spark.range(1).select(cron.cron_spec(F.lit(expr))["valid"]).first()[0] is valid


def test_equal_schedule_keys_are_numbered(spark):
    declared = schedule(spark, "0 * * * *", "*/15 * * * *", "0 * * * *", "0 * * * *").withColumn("schedule_key", F.lit(""))
    kept = schedule(spark, "0 * * * *").withColumns({"job_key": F.lit("other"), "schedule_key": F.lit(" mine ")})
    got = schedules.resolved_keys(declared.unionByName(kept))
    assert rows(got, "job_key", "sort_index", "schedule_key") == [
        ("job", 0, "hourly"), ("job", 1, "every_15_minutes"), ("job", 2, "hourly_2"), ("job", 3, "hourly_3"),
        ("other", 0, "mine"),
    ]


def test_scalars(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    assert value(status.exec_status(F.lit(" Cancelled\n"))) == "canceled"
    assert value(status.display_status(F.lit("idle"))) == "pending"
    assert value(status.timeline_state(F.lit("whatever"))) == "running"
    assert value(text.truncate_note(F.lit("abcdef"), 4)) == "abcd… (2 chars truncated)"
    assert value(text.slug(F.lit("---"))) == "schedule"
    assert value(times.stored_time(F.lit("2026-03-01T10:00:00.123456789Z"))) == at("2026-03-01T10:00:00.123456")
    assert value(times.stored_time(F.lit("2026-03-01"))) is None
    assert value(params.rfc3339(F.lit(at("2026-03-01T10:20:30.120000")))) == "2026-03-01T10:20:30.12Z"
    assert value(params.rfc3339(F.lit(at("2026-03-01T10:20:30")))) == "2026-03-01T10:20:30Z"


@pytest.mark.parametrize(
    "text_, error, item",
    [
        ('{"workflow_queue":{"queue_key":"q","queue_item_id":7,"partition_key":"p"}}', "", 7),
        ('{"workflow_queue":{"queue_key":"q","queue_item_id":7.9,"partition_key":"p"}}', "", 7),
        ('{"workflow_queue":{"queue_key":"q","queue_item_id":"7","partition_key":"p"}}', "queue params are incomplete", 0),
        ('{"workflow_queue":{"queue_key":5,"queue_item_id":7,"partition_key":"p"}}', "queue params are incomplete", 7),
        ('{"workflow_queue":[1]}', "queue params payload is invalid", 0),
        ('{"other":1}', None, None),
        ("not json", None, None),
    ],
)
def test_queue_meta(spark, text_, error, item):
    meta = spark.createDataFrame([(text_,)], "p string").select(params.queue_meta(F.col("p"))).first()[0]
    assert (meta and meta.error, meta and meta.queue_item_id) == (error, item)


def test_exported_times(spark):
    exported = spark.createDataFrame(
        [("s", "2026-03-01T10:00:00Z", ""), ("t", "2026-03-01 10:00:00", "x")],
        "scheduler_key string, last_heartbeat_at string, updated_at string",
    )
    got = typed_times(exported, "scheduler_heartbeats")
    assert rows(got) == [("s", at("2026-03-01T10:00:00"), None), ("t", at("2026-03-01T10:00:00"), None)]


def test_failed_step_skips_what_depends_on_it(spark):
    run = spark.createDataFrame(
        [(1, "source", "success", ""), (1, "transform", "failed", "boom"), (1, "publish", "pending", "")],
        "run_id long, step_key string, status string, error_message string",
    )
    edges = spark.createDataFrame(
        [(1, "source", "transform"), (1, "transform", "publish")], "run_id long, from_step_key string, to_step_key string"
    )
    skipped = execution.skipped_steps(run, edges)
    assert rows(skipped) == [(1, "publish", "skipped", "dependency output unavailable")]
    order = graph.graph_order(run.withColumnRenamed("run_id", "job_id"), edges.withColumnRenamed("run_id", "job_id"))
    outcome = counts.run_outcome(
        run.join(order.withColumnRenamed("job_id", "run_id"), ["run_id", "step_key"]), order="topo_index"
    )
    assert rows(outcome) == [(1, "failed", "boom")]


def test_rerun_of_one_step(spark):
    runs = spark.createDataFrame(
        [(1, 0, ""), (2, 1, "b"), (3, 1, "c")], "id long, parent_run_id long, rerun_step_key string"
    )
    steps_ = spark.createDataFrame(
        [(r, k, s, "{}") for r in (1, 2, 3) for k, s in (("a", "success"), ("b", "failed"), ("c", "pending"))],
        "run_id long, step_key string, status string, output_json string",
    )
    edges = spark.createDataFrame(
        [(r, f, t) for r in (1, 2, 3) for f, t in (("a", "b"), ("b", "c"))],
        "run_id long, from_step_key string, to_step_key string",
    )
    plan = execution.rerun_plan(runs, steps_, edges)
    assert rows(plan.filter("action = 'run'"), "run_id", "step_key") == [(2, "b")]
    assert rows(plan.filter("run_id = 3 and step_key = 'c'"), "reason") == [("dependency output unavailable",)]


CONTRACT = "job_id long, step_key string, field_pos long, field_name string, field_type string"
OUTPUT = "job_id long, step_key string, type_name string"


@pytest.mark.parametrize(
    "field_type, makers, bound, message",
    [
        ("m.T", 0, 0, "input field F (m.T) requires exactly 1 provider, found 0"),
        ("m.T", 1, 1, None),
        ("m.T", 2, 0, "input field F (m.T) is ambiguous: expected exactly 1 provider, found 2"),
        ("*m.T", 0, 0, None),
        ("*m.T", 1, 1, None),
        ("*m.T", 2, 0, "input field F (m.T) is ambiguous: pointer input allows 0 or 1 provider, found 2"),
        ("[]m.T", 0, 0, None),
        ("[]m.T", 3, 3, None),
        ("[]string", 0, 0, "input field F: unsupported slice input type []string: expected []T where T is a struct"),
    ],
)
def test_provider_rules(spark, field_type, makers, bound, message):
    fields = spark.createDataFrame([(1, "me", 1, "F", field_type)], CONTRACT)
    # The step itself makes the same type and is never its own provider.
    outputs = spark.createDataFrame([(1, "me", "m.T")] + [(1, f"p{i}", "m.T") for i in range(makers)], OUTPUT)
    assert contracts.providers(fields, outputs).count() == bound
    assert [m for (m,) in rows(contracts.contract_errors(fields, outputs), "message")] == ([message] if message else [])


def test_slice_providers_follow_execution_order(spark):
    fields = spark.createDataFrame([(1, "sink", 1, "All", "[]m.T"), (1, "a_source", 1, "In", "m.Z")], CONTRACT)
    outputs = spark.createDataFrame([(1, "z_source", "m.T"), (1, "a_source", "m.T"), (1, "root", "m.Z"), (1, "sink", "m.S")], OUTPUT)
    bound = contracts.providers(fields, outputs)
    edges = bound.select("job_id", F.col("provider").alias("from_step_key"), F.col("step_key").alias("to_step_key"))
    # a_source has to wait for root, so the root z_source could still come after it by key alone.
    order = graph.graph_order(outputs, edges)
    got = contracts.ordered_providers(bound, order).filter("step_key = 'sink'")
    assert [r.provider for r in got.orderBy("provider_index").collect()] == ["a_source", "z_source"]
    later = outputs.filter("step_key <> 'root'").unionByName(spark.createDataFrame([(1, "zz_root", "m.Z")], OUTPUT))
    bound = contracts.providers(fields, later)
    edges = bound.select("job_id", F.col("provider").alias("from_step_key"), F.col("step_key").alias("to_step_key"))
    got = contracts.ordered_providers(bound, graph.graph_order(later, edges)).filter("step_key = 'sink'")
    assert [r.provider for r in got.orderBy("provider_index").collect()] == ["z_source", "a_source"]


def test_typed_step_checks_both_ends(spark):
    takes = StructType([StructField("id", LongType())])
    gives = StructType([StructField("name", StringType())])
    good = steps.typed_step("s", takes, gives, lambda df: df.select(F.col("id").cast("string").alias("name")))
    assert rows(spark.range(2).transform(good)) == [("0",), ("1",)]
    bad = steps.typed_step("s", takes, gives, lambda df: df.select(F.col("id").alias("name")))
    with pytest.raises(steps.ContractError, match="output column name is bigint"):
        spark.range(1).transform(bad)
    with pytest.raises(steps.ContractError, match="input lacks column id"):
        spark.range(1).toDF("x").transform(good)


def test_content_record(spark):
    body = "<html><head><title>Flow</title></head><body>Nothing else.</body></html>"
    pages = spark.createDataFrame([("https://example.com/blog", body), ("u", "")], "url string, body string")
    got = content.index_records(pages, ["A", "B"], ["SQLite"], ["https://example.com/docs"])
    assert rows(got, "url", "title", "records") == [("https://example.com/blog", "Flow", 5), ("u", "Untitled", 5)]


def test_customer_import(spark):
    items = spark.createDataFrame(
        [('{"customer_id":"customer-123","batch_id":"batch-001"}',), ('{"batch_id":"b"}',), ('{"customer_id":""}',)], "p string"
    )
    good, bad = content.import_customers(items, F.col("p"))
    assert rows(good, "external_id", "partition_key") == [("crm:customer-123", "customer-123")]
    assert bad.count() == 2


def test_job_without_nodes_is_rejected(spark):
    requests = spark.createDataFrame(
        [("r1", 1, " ", "", None, None, None, None, None), ("r2", 2, "x", "{}", None, 5, "s", "", {"k": "v"})],
        "run_key string, job_id long, triggered_by string, params_json string, queued_at timestamp, parent_run_id long, "
        "rerun_step_key string, error_message string, event_payload map<string,string>",
    )
    nodes = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "job_id long, step_key string, sort_index long")
    made = store.insert_queued_runs(requests, nodes, times.literal_time("2026-01-01 00:00:00"))
    assert rows(made.runs, "run_key", "triggered_by", "params_json", "parent_run_id") == [("r1", "manual", "{}", 0)]
    assert rows(made.steps, "run_key", "step_key", "status") == [("r1", "a", "pending"), ("r1", "b", "pending")]
    assert rows(made.rejected, "run_key", "error") == [("r2", "job has no nodes")]


def test_a_status_is_cleaned_once_a_row(spark):
    words = spark.createDataFrame([(" Failed ",), ("CANCELLED",), ("in_progress",), ("idle",), ("queued",), ("odd",), (None,)], "s string")
    shown = {
        "display": (status.display_status, ["failed", "canceled", "running", "pending", "queued", "pending", "pending"]),
        "timeline": (status.timeline_state, ["failed", "failed", "running", "running", "running", "running", "running"]),
        "group": (status.step_group, ["failed", "failed", "executing", "not_executed", "preparing", "not_executed", "not_executed"]),
        "visual": (status.step_visual_state, ["failed", "failed", "running", "not-executed", "not-executed", "not-executed", "not-executed"]),
    }
    for fn, wanted in shown.values():
        one = words.select(fn(F.col("s")).alias("shown"))
        assert [r.shown for r in one.collect()] == wanted
        assert one._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
