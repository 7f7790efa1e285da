"""The paths taken for hot groups, deep graphs and repeated batches agree with plain answers."""

import datetime as dt
import hashlib
import random
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from flowledger.catalog import QUERIES
from flowledger.catalog import content as content_queries
from flowledger.catalog import stored as stored_queries
from flowledger.functions import cron, times
from flowledger.operators import contracts, content, counts, execution, filters, graph, layers, schedules
from flowledger.operators.ranking import rank_within
from flowledger.session import scratch_root
from flowledger.sources import artifacts, derived
from flowledger.streaming import fold, ingest, sinks

EDGES = "job_id long, from_step_key string, to_step_key string"
NODES = "job_id long, step_key string"


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_groups_rank_like_others(spark):
    rng = random.Random(5)
    places = rng.sample(range(100_000), 3000)
    data = [("hot" if i % 3 else f"g{i % 50}", p) for i, p in enumerate(places)]
    rows = spark.createDataFrame(data, "g string, v long")
    got = rank_within(rows, ["g"], [F.col("v").asc()])
    want, seen = [], {}
    for g, v in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, v, seen[g]))
    assert table(got) == want


def random_graphs(rng, jobs):
    nodes, edges = [], []
    for job in range(jobs):
        names = [f"n{i:02d}" for i in rng.sample(range(100), rng.randint(1, 12))]
        nodes += [(job, n) for n in names]
        order = names[:]
        rng.shuffle(order)
        for i, a in enumerate(order):
            edges += [(job, a, b) for b in order[i + 1 :] if rng.random() < 0.25]
        if rng.random() < 0.3 and len(order) > 1:
            edges.append((job, order[-1], order[0]))
        if rng.random() < 0.2:
            edges.append((job, order[0], order[0]))
        edges.append((job, "ghost", order[0]))
    return nodes, edges


def test_graph_order_takes_the_smallest_ready_key(spark):
    nodes, edges = random_graphs(random.Random(11), 60)
    order = graph.graph_order(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = {}
    for r in order.orderBy("job_id", "topo_index").collect():
        got.setdefault(r.job_id, []).append((r.step_key, r.stuck))
    for job, steps in got.items():
        names = {n for j, n in nodes if j == job}
        needs = {n: {a for j, a, b in edges if j == job and b == n and a in names} for n in names}
        done = []
        while ready := sorted(n for n in names.difference(done) if needs[n] <= set(done)):
            done.append(ready[0])
        assert steps == [(n, False) for n in done] + [(n, True) for n in sorted(names.difference(done))]
    assert not graph.cyclic_jobs(order).isEmpty()


def test_order_of_literal_graphs(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "d")]
    edges += [(2, x, y) for x in "ab" for y in "zy"]
    edges += [(3, "a", "b"), (3, "b", "a"), (4, "a", "a")]
    nodes = sorted({(j, k) for j, a, b in edges for k in (a, b)})
    order = graph.graph_order(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    seen = {}
    for r in order.orderBy("job_id", "topo_index").collect():
        seen.setdefault(r.job_id, []).append(r.step_key)
    assert seen[1] == list("abcd") and seen[2] == ["a", "b", "y", "z"]
    assert table(graph.cyclic_jobs(order)) == [(3, 2), (4, 1)]


def test_long_chain_and_wide_star(spark):
    size = 1000
    chain = [(1, f"n{i:04d}", f"n{i + 1:04d}") for i in range(size - 1)]
    star = [(2, "root", f"leaf{i:04d}") for i in range(size)]
    edges = spark.createDataFrame(chain + star, EDGES)
    nodes = edges.select("job_id", F.explode(F.array("from_step_key", "to_step_key")).alias("step_key")).distinct()
    order = graph.graph_order(nodes, edges)
    by_place = [r.step_key for r in order.filter("job_id = 1").orderBy("topo_index").collect()]
    assert by_place == [f"n{i:04d}" for i in range(size)]
    assert order.filter("job_id = 2 and topo_index = 0").first().step_key == "root"
    assert order.filter("job_id = 1").agg(F.max("depth")).first()[0] == size - 1


def test_reachability_of_a_chain_and_of_cycles(spark):
    chain = [(1, f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    loop = [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "c", "d")]
    pairs = graph.reachable(spark.createDataFrame(chain + loop, EDGES))
    assert pairs.filter("job_id = 1").count() == 61 * 60 // 2
    assert table(pairs.filter("job_id = 2").select("from_step_key", "to_step_key")) == sorted(
        (a, b) for a in "abc" for b in "abcd"
    )


def test_transitive_reduction(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "c")], EDGES)
    assert table(layers.reduced_edges(edges)) == [(1, "a", "b"), (1, "b", "c")]


def test_skips_travel_down_deep_chains(spark):
    size = 16
    edges = spark.createDataFrame(
        [(1, f"n{i:03d}", f"n{i + 1:03d}") for i in range(size)], "run_id long, from_step_key string, to_step_key string"
    )
    steps = spark.createDataFrame(
        [(1, f"n{i:03d}", "failed" if i == 0 else "success" if i == 12 else "pending") for i in range(size + 1)],
        "run_id long, step_key string, status string",
    )
    want = [(1, f"n{i:03d}") for i in range(1, 12)]
    assert table(execution.skipped_steps(steps, edges).select("run_id", "step_key")) == want


def test_schedule_keys_that_collide_across_names(spark):
    rng = random.Random(3)
    crons = ["0 * * * *", "*/5 * * * *", "* * * * *"]
    names = ["", "", "", "hourly", "hourly_2", "hourly_3", "every_minute", "every_5_minutes_2", "own"]
    data = [(f"j{j}", rng.choice(names), rng.choice(crons), i) for j in range(8) for i in range(25)]
    base = {"0 * * * *": "hourly", "*/5 * * * *": "every_5_minutes", "* * * * *": "every_minute"}
    want, used = [], {}
    for job, key, expr, i in sorted(data, key=lambda r: (r[0], r[3])):
        taken = used.setdefault(job, set())
        if not key:
            key, n = base[expr], 1
            while key in taken:
                n += 1
                key = f"{base[expr]}_{n}"
        taken.add(key)
        want.append((job, i, key))
    rows = spark.createDataFrame(data, "job_key string, schedule_key string, cron_expr string, sort_index long")
    got = schedules.resolved_keys(rows).select("job_key", "sort_index", "schedule_key")
    assert table(got) == sorted(want)


def test_long_schedule_lists_are_numbered(spark):
    rows = spark.range(500).select(
        F.lit("j").alias("job_key"), F.lit("").alias("schedule_key"), F.lit("0 * * * *").alias("cron_expr"),
        F.col("id").alias("sort_index"),
    )
    got = schedules.resolved_keys(rows).orderBy("sort_index").select("schedule_key")
    assert [r[0] for r in got.collect()] == ["hourly"] + [f"hourly_{i}" for i in range(2, 501)]


def _walked_keys(data):
    """Keys by the rule itself, row after row; data is (job, explicit key, base, cron, place)."""
    want, used = [], {}
    for job, key, base, _, i in sorted(data, key=lambda r: (r[0], r[4])):
        taken, reached = used.setdefault(job, (set(), {}))
        if not key:
            n = reached.get(base, 1)
            while (key := base if n == 1 else f"{base}_{n}") in taken:
                n += 1
            reached[base] = n
        taken.add(key)
        want.append((job, i, key))
    return sorted(want)


def _resolved(spark, data):
    rows = spark.createDataFrame([(job, key, cron, i) for job, key, _, cron, i in data], "job_key string, schedule_key string, cron_expr string, sort_index long")
    return table(schedules.resolved_keys(rows).select("job_key", "sort_index", "schedule_key"))


def test_schedule_keys_of_bases_that_claim_one_anothers_names(spark):
    rng = random.Random(8)
    # the key of the second expression reads like the second key of the first, and so on
    crons = {"1 2 3 4 *": "cron_1_2_3_4", "1 2 3 4 2": "cron_1_2_3_4_2", "1 2 3 4 3": "cron_1_2_3_4_3", "0 * * * *": "hourly"}
    names = [""] * 8 + ["cron_1_2_3_4", "cron_1_2_3_4_2_2", "cron_1_2_3_4_5", "cron_1_2_3_4_05", "cron_1_2_3_4_1", "hourly_2", "hourly_99999999999999999999"]
    data = []
    for j in range(30):
        for i in range(rng.randrange(1, 40)):
            cron = rng.choice(list(crons))
            data.append((f"j{j}", rng.choice(names), crons[cron], cron, i))
    assert _resolved(spark, data) == _walked_keys(data)


def test_a_crowded_job(spark):
    """100,000 schedules that collide, with explicit keys before, among and after them."""
    rng = random.Random(4)
    data = []
    for i in range(100_000):
        key = f"hourly_{rng.randrange(2, 150_000)}" if rng.random() < 0.4 else "hourly" if i == 70 else ""
        data.append(("j", key, "hourly", "0 * * * *", i))
    assert _resolved(spark, data) == _walked_keys(data)


def _values(field, low, high):
    out = set()
    for part in field.split(","):
        base, _, step = part.partition("/")
        first, _, last = base.partition("-")
        if base == "*":
            first, last = low, high
        out |= set(range(int(first), int(last or first) + 1, int(step or 1)))
    return out


def test_occurrences_against_brute_force(spark):
    rng = random.Random(17)
    zones = ["UTC", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kathmandu", "Europe/Berlin", "America/New_York"]
    data = []
    for i in range(40):
        minute = rng.choice(["*", "*/7", "0", "15,45", "1-59/13"])
        hour = rng.choice(["*", "2", "1-3", "*/6", "23,0"])
        dom = rng.choice(["*", "*", "1", "28-31", "*/10"])
        month = rng.choice(["*", "3", "10-11"])
        dow = rng.choice(["*", "*", "0", "1-5"])
        data.append(("j", f"s{i}", f"{minute} {hour} {dom} {month} {dow}", rng.choice(zones)))
    for start, end in ((dt.datetime(2026, 3, 6, 3, 1, 30), dt.datetime(2026, 3, 9, 4, 0)),
                       (dt.datetime(2026, 10, 30, 23, 59), dt.datetime(2026, 11, 2, 1, 30, 5)),
                       (dt.datetime(2026, 4, 4, 10, 0), dt.datetime(2026, 4, 5, 2, 0))):
        want = []
        for _, key, expr, zone in data:
            minute, hour, dom, month, dow = expr.split()
            sets = _values(minute, 0, 59), _values(hour, 0, 23), _values(dom, 1, 31), _values(month, 1, 12), _values(dow, 0, 6)
            t = start.replace(second=0) + dt.timedelta(minutes=1)
            while t <= end:
                local = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
                by_date, by_day = local.day in sets[2], (local.weekday() + 1) % 7 in sets[4]
                day = by_day if dom == "*" else by_date if dow == "*" else by_date or by_day
                if dom == "*" and dow == "*":
                    day = True
                if local.minute in sets[0] and local.hour in sets[1] and local.month in sets[3] and day:
                    want.append((key, t))
                t += dt.timedelta(minutes=1)
        rows = spark.createDataFrame(data, "job_key string, schedule_key string, cron_expr string, timezone string")
        got = schedules.occurrences(rows, F.lit(start), F.lit(end)).select("schedule_key", "tick")
        assert table(got) == sorted(want)


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    waits = [(rng.randint(1, 3), rng.randint(0, 500_000)) for _ in range(400)]
    base = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame(
        [(j, base, base + dt.timedelta(milliseconds=w)) for j, w in waits],
        "job_id long, queued_at timestamp, started_at timestamp",
    )
    got = {r.job_id: r for r in counts.queue_latency(rows, (0.5, 0.95)).collect()}
    for job in (1, 2, 3):
        values = sorted(w for j, w in waits if j == job)
        for share, name in ((0.5, "p50_ms"), (0.95, "p95_ms")):
            assert got[job][name] == values[-(-len(values) * int(share * 100) // 100) - 1]


def test_trailing_day_against_brute_force(spark):
    rng = random.Random(9)
    base = dt.datetime(2026, 1, 1)
    data = [
        (i, base + dt.timedelta(seconds=rng.choice([rng.randint(0, 400_000), 86_400 * rng.randint(0, 4) + 5])), rng.randint(1, 3),
         rng.randint(0, 500) / 100)
        for i in range(500)
    ]
    rows = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, value double")
    got = {r.event_id: (r.events_24h, r.cents_24h) for r in content.trailing_day_features(rows).collect()}
    for i, ts, user, _ in data:
        near = [round(v * 100) for _, t, u, v in data if u == user and dt.timedelta(0) <= ts - t <= dt.timedelta(seconds=86_399)]
        assert got[i] == (len(near), sum(near))


def test_ambiguous_field_with_very_many_providers(spark):
    fields = spark.createDataFrame(
        [(1, "me", 1, "F", "m.T")], "job_id long, step_key string, field_pos long, field_name string, field_type string"
    )
    outputs = spark.createDataFrame([(1, f"p{i}", "m.T") for i in range(2000)] + [(1, "me", "m.T")], "job_id long, step_key string, type_name string")
    (message,) = contracts.contract_errors(fields, outputs).select("message").first()
    assert message == "input field F (m.T) is ambiguous: expected exactly 1 provider, found 2000"
    assert {r.candidate for r in contracts.ambiguous_candidates(fields, outputs).collect()} == {f"p{i}" for i in range(2000)}


def test_next_run_far_away(spark):
    rows = spark.createDataFrame(
        [("j", "leap", "0 0 29 2 *", "UTC"), ("j", "daily", "30 6 * * *", "UTC"), ("j", "never", "0 0 31 2 *", "UTC")],
        "job_key string, schedule_key string, cron_expr string, timezone string",
    )
    got = {r.schedule_key: r.next_run_at for r in schedules.next_ticks(rows, times.literal_time("2096-03-01 00:00:00")).collect()}
    assert got == {"daily": dt.datetime(2096, 3, 1, 6, 30)}
    far = (1, 366, 9 * 366)
    got = {r.schedule_key: r.next_run_at for r in schedules.next_ticks(rows, times.literal_time("2096-03-01 00:00:00"), windows=far).collect()}
    assert got == {"daily": dt.datetime(2096, 3, 1, 6, 30), "leap": dt.datetime(2104, 2, 29)}


def test_offsets_and_abbreviations_are_no_zones(spark):
    names = ["Europe/Berlin", "UTC", "", "Japan", "+05:30", "PST", "GMT+5", "Mars/Olympus", "utc"]
    rows = spark.createDataFrame([(n,) for n in names], "z string")
    got = {r.z: r.known for r in rows.select("z", cron.zone_known(F.col("z")).alias("known")).collect()}
    assert [n for n in names if got[n]] == ["Europe/Berlin", "UTC", "", "Japan"]


def test_blank_needles_cross_texts_only_where_they_touch(spark):
    queues = spark.createDataFrame(
        [(1, "q1", "Q one", "", "/r")], "id long, queue_key string, display_name string, description string, route_path string"
    )
    jobs = spark.createDataFrame([(1, "aa", "A"), (2, "bb", "B"), (3, "cc", "C")], "id long, job_key string, display_name string")
    attached = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "queue_id long, job_id long, sort_index long")
    for text, hit in (("aa b", 1), ("/r a aa b bb c", 1), ("aa c", 0), ("BB", 1), ("", 1)):
        assert filters.search_queues(queues, attached, jobs, text).count() == hit, text


def test_repeated_batches_count_once(spark):
    sink = sinks.BatchSink(f"{scratch_root(spark)}/repeat")
    rows = spark.range(3).toDF("k")
    sink.write(0, t=rows)
    sink.write(0, t=rows)
    # Written but never committed: the tables of a batch that died half way.
    rows.write.parquet(f"{sink.folder}/t/batch=1")
    assert sink.read(spark, "t", rows.schema).count() == 3
    assert sinks.BatchSink(f"{scratch_root(spark)}/nothing").read(spark, "t", rows.schema).count() == 0


def test_loaders_drain_or_run_on(spark, tmp_path):
    spark.range(5).toDF("k").write.parquet(str(tmp_path / "in"))
    rows = sinks.table_stream(spark, spark.range(1).toDF("k").schema, str(tmp_path / "in"))
    for mode in ("poll", "stream"):
        sink = sinks.BatchSink(str(tmp_path / mode))
        running = sinks.load_stream(mode, rows, str(tmp_path / f"{mode}-state"), fold.updates_to(sink, "t"))
        if mode == "poll":
            running.awaitTermination()
        else:
            running.processAllAvailable()
            assert running.isActive
            running.stop()
        assert table(sink.read(spark, "t", rows.schema).select("k")) == [(i,) for i in range(5)]


ARRIVALS = (
    "queue_id long, queue_key string, source_key string, external_key string, payload_json string, queued_at timestamp, "
    "customer string"
)


def test_items_are_taken_whole_or_not_at_all(spark):
    arrivals = spark.createDataFrame(
        [
            (1, "orders", "1", " ext_123 ", '{"id":"ord_123"}', None, "c1"),
            (1, "orders", "2", " ext_123 ", '{"id":"ord_123"}', None, "c1"),
            (2, "broken", "3", "", "{}", None, "c2"),
            (1, "orders", "4", "", "{}", None, "  "),
        ],
        ARRIVALS,
    )
    now = times.literal_time("2026-01-01 00:00:00")
    queue_jobs = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (2, 8, 1)], "queue_id long, job_id long, sort_index long")
    nodes = spark.createDataFrame([(7, "import", 0)], "job_id long, step_key string, sort_index long")
    items, rejected = ingest.ingest(arrivals, F.col("customer"), now)
    queued, links, broken = ingest.fan_out(items, F.col("source_key").cast("long"), queue_jobs, nodes, now)
    assert table(rejected.select("source_key", "error")) == [("4", "partition key is required")]
    assert table(broken.select("source_key", "error")) == [("3", "job has no nodes")]
    assert queued.runs.count() == links.count() == queued.steps.count() == 2
    assert {r.external_key for r in items.filter("queue_id = 1").collect()} == {"ext_123"}
    again, _ = ingest.ingest(arrivals, F.col("customer"), now)
    assert table(items.select("queue_item_key")) == table(again.select("queue_item_key"))


def test_event_sequence_folds_to_run_and_step_states(spark):
    log = [
        ("", "run_queued", "{}"), ("", "run_started", "{}"), ("source", "step_started", "{}"), ("source", "step_log", "{}"),
        ("source", "step_succeeded", "{}"), ("transform", "step_started", "{}"), ("transform", "step_failed", "{}"),
        ("publish", "step_skipped", "{}"), ("", "run_completed", '{"status":"failed"}'), ("", "run_canceled", "{}"),
    ]
    base = dt.datetime(2026, 1, 1)
    rows = [(i, 1, k, t, p, base + dt.timedelta(seconds=i)) for i, (k, t, p) in enumerate(log)]
    events = spark.createDataFrame(
        rows, "id long, run_id long, step_key string, event_type string, event_data_json string, created_at timestamp"
    )
    assert fold.run_states(events).first().status == "failed"
    assert {r.step_key: r.status for r in fold.step_states(events).collect()} == {
        "source": "success", "transform": "failed", "publish": "skipped"
    }


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())


def test_runs_that_match_schedules_are_spread_over_tasks(spark):
    runs = spark.createDataFrame([(i, "j", dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(200)], "id long, job_key string, queued_at timestamp").coalesce(1)
    declared = spark.createDataFrame([("j", f"s{i}", "* * * * *", "UTC") for i in range(5)], "job_key string, schedule_key string, cron_expr string, timezone string")
    got = schedules.matching_schedules(runs, declared, "queued_at").select("id", "schedule_key", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.schedule_key) for r in got) == sorted((i, f"s{k}") for i in range(200) for k in range(5))
    assert len({r.task for r in got}) > 1


def test_runs_do_not_move_to_meet_few_jobs_and_schedules(spark, tmp_path):
    spark.range(30_000).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "concat(id % 5 + 1, '-P') as o_orderpriority", "rand() as o_totalprice", "date '2024-01-01' as o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 << 10))
    try:
        matches = QUERIES["J2_cron_matches_runs"](spark, str(tmp_path))
        plan = matches._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_of_one_file_is_ingested_by_many_tasks(spark, tmp_path):
    arrivals = spark.createDataFrame(
        [(1 + i % 2, f"q{1 + i % 2}", str(i), f"e{i}", "{}", dt.datetime(2024, 1, 1), f"k{i}") for i in range(300)],
        "queue_id long, queue_key string, source_key string, external_key string, payload_json string, queued_at timestamp, raw_key string",
    ).coalesce(1)
    queue_jobs = spark.createDataFrame([(1, 7, 0), (2, 8, 0)], "queue_id long, job_id long, sort_index long")
    nodes = spark.createDataFrame([(7, "a", 1), (7, "b", 2)], "job_id long, step_key string, sort_index long")
    sink = sinks.BatchSink(f"{tmp_path}/out")
    ingest.ingest_batches(sink, F.col("raw_key"), F.lit(dt.datetime(2024, 1, 1)), F.col("source_key").cast("long"), queue_jobs, nodes)(arrivals, 0)
    stored = {name: spark.read.parquet(f"{tmp_path}/out/{name}/batch=0") for name in ("items", "runs", "steps", "events", "links", "rejected")}
    assert {name: rows.count() for name, rows in stored.items()} == {"items": 150, "runs": 150, "steps": 300, "events": 150, "links": 150, "rejected": 150}
    assert stored["items"].columns[:2] == ["queue_item_key", "queue_id"]
    for name in ("items", "runs", "steps", "events", "links"):
        assert stored[name].select(F.input_file_name()).distinct().count() > 1


def test_objects_in_folders_below_are_listed_by_name(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"page_id={i}").mkdir()
        (tmp_path / f"page_id={i}" / "part.txt").write_bytes(b"x" * (i + 1))
        (tmp_path / f"page_id={i}" / "part.csv").write_bytes(b"y")
    assert table(artifacts.object_scan(spark, str(tmp_path), "*.txt").select("length")) == [(i + 1,) for i in range(40)]


def test_pages_are_written_as_one_file_each(spark, tmp_path):
    """Beside its file Spark's writer puts a checksum, and starts a process for the permissions of each."""
    pages = [(3, "three"), (1, "é"), (None, "no id"), (3, "again"), (2, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    history = derived.History(spark, str(tmp_path))
    path = Path(content_queries._page_files(history).removeprefix("file:"))
    bodies = {file.parent.name: sorted(file.read_text().split("\n")) for file in path.rglob("*") if file.is_file()}
    assert bodies == {"page_id=1": ["", "é"], "page_id=2": ["", ""], "page_id=3": ["", "again", "three"], "page_id=4": ["", ""], "page_id=__HIVE_DEFAULT_PARTITION__": ["", "no id"]}
    assert all(len(list(folder.iterdir())) == 1 for folder in path.iterdir())
    assert table(QUERIES["A5_listed_objects"](spark, str(tmp_path))) == [("", 6), ("1", 3), ("2", 1), ("3", 12), ("4", 1)]
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert table(QUERIES["A5_listed_objects"](spark, f"{tmp_path}/none")) == []


def test_objects_of_any_size_have_a_digest(spark, tmp_path):
    """One is larger than a cell can be; the others are on both sides of what is read as a whole."""
    with open(tmp_path / "large 1%2B#.bin", "wb") as file:
        file.truncate((1 << 31) + 5)
    (tmp_path / "a.gz").write_bytes(b"\x1f\x8b not packed" * 9)
    zeros = hashlib.sha256()
    for _ in range(1 << 8):
        zeros.update(bytes(1 << 23))
    zeros.update(bytes(5))
    want = [("a.gz", 117, hashlib.sha256(b"\x1f\x8b not packed" * 9).hexdigest()), ("large 1%2B#.bin", (1 << 31) + 5, zeros.hexdigest())]
    assert table(QUERIES["A5_object_scan"](spark, str(tmp_path))) == want
    for whole in (0, 116, 117):
        digests = artifacts.object_digests(artifacts.object_scan(spark, str(tmp_path)), whole)
        assert table(digests.select(F.element_at(F.split("path", "/"), -1), "length", "digest")) == want


def test_stored_views_are_built_once_from_the_input(spark, tmp_path):
    columns = "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_shipdate date"
    lines = [(o, n, "A", "F" if n % 2 else "O", 3.0 * n, 10.5, dt.date(2024, 1, n)) for o in range(5) for n in range(1, 5)]
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = derived.History(spark, str(tmp_path))
    stored = plain.stored("job_nodes")
    for name in ("job_nodes", "job_edges", "run_steps", "contract_fields"):
        rows = getattr(stored, name)
        assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, getattr(plain, name).collect()), key=repr)
    inputs = content_queries._inputs(plain)
    assert "l_orderkey" not in inputs._jdf.queryExecution().optimizedPlan().toString()
    assert inputs.count() > 0


def test_items_do_not_move_to_meet_the_few_jobs_of_queues(spark, tmp_path):
    kinds = "case id % 5 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end"
    spark.range(30_000).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "xxhash64(id) as user_id", f"{kinds} as event_type", "0D as value", "concat('{\"k\": ', id, '}') as props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(30_000).selectExpr("id div 3 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "'A' as l_returnflag", "'F' as l_linestatus", "1D as l_quantity", "rand() as l_extendedprice", "date '2024-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 << 10))
    try:
        events = stored_queries._queued(derived.History(spark, str(tmp_path))).events
        assert "SortMergeJoin" not in events._jdf.queryExecution().executedPlan().toString()
        assert events.count() == 60_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
