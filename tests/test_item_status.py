"""Item status over two streams: links and changes in any order, items that grow over a restart, changes without a link."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from flowledger.operators.counts import item_lifecycle
from flowledger.streaming import item_status, sinks

LINKS = "id long, queue_item_id long, run_id long, created_at timestamp"
CHANGES = "run_id long, change_id long, status string, started_at timestamp, completed_at timestamp, error_message string"
SCHEMA = "queue_item_id long, status string, started_at timestamp, completed_at timestamp, error_message string"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def histories(seed=5):
    """An item with 120 runs, small ones, one whose run never changes, and a run that has no item."""
    rng = random.Random(seed)
    links, changes = [], []
    for run in range(200):
        item = 1 if run < 120 else 2 + run % 9
        links.append((run, item, run, at(rng.randrange(50))))
        if run == 199:
            continue
        for nth in range(rng.randrange(1, 4)):
            status = rng.choice(["queued", "running", "success", "failed", "canceled"]) if nth else "queued"
            ended = status in ("success", "failed", "canceled")
            changes.append((run, 10 * run + nth, status, at(run) if nth else None, at(run + 9) if ended else None, f"e{run}" if status == "failed" else ""))
    changes.append((999, 1, "failed", at(1), at(2), "lost"))
    rng.shuffle(links)
    rng.shuffle(changes)
    return links, changes


def expected(spark, links, changes):
    last = {}
    for change in changes:
        if change[0] not in last or change[1] > last[change[0]][1]:
            last[change[0]] = change
    joined = [(item, id_, created, c[2], c[3], c[4], c[5]) for id_, item, run, created in links if (c := last.get(run))]
    kind = "queue_item_id long, id long, created_at timestamp, run_status string, started_at timestamp, completed_at timestamp, run_error_message string"
    return {tuple(r) for r in item_lifecycle(spark.createDataFrame(joined, kind)).collect()}


def streams(spark, folder):
    return [sinks.table_stream(spark, spark.createDataFrame([], kind).schema, f"{folder}/{name}", files_per_batch=1) for name, kind in (("changes", CHANGES), ("links", LINKS))]


def add(spark, folder, name, kind, rows):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_links_and_changes_in_any_order_and_over_a_restart(spark, tmp_path):
    links, changes = histories()
    sink, state = sinks.BatchSink(f"{tmp_path}/out"), f"{tmp_path}/state"
    for half in range(2):  # the second half makes the wide item grow after a restart
        for third in range(3):
            add(spark, tmp_path, "changes", CHANGES, changes[half::2][third::3])
            add(spark, tmp_path, "links", LINKS, links[half::2][third::3])
        item_status.sync_item_status(*streams(spark, tmp_path), sink, state).awaitTermination()
        done = sink.latest(spark, item_status.TABLE, spark.createDataFrame([], SCHEMA).schema, "queue_item_id")
        seen = (links, changes) if half else (links[0::2], changes[0::2])
        assert {tuple(r) for r in done.collect()} == expected(spark, *seen)


def test_a_change_without_link_is_forgotten_after_the_wait(spark, tmp_path):
    sink = sinks.BatchSink(f"{tmp_path}/out")
    schema = spark.createDataFrame([], SCHEMA).schema
    add(spark, tmp_path, "changes", CHANGES, [(1, 1, "failed", None, None, "old"), (2, 2, "running", None, None, "")])
    add(spark, tmp_path, "links", LINKS, [(2, 20, 2, at(0))])
    query = item_status.sync_item_status(*streams(spark, tmp_path), sink, f"{tmp_path}/state", poll_every="1 second", wait_ms=1000)

    def until(items):
        for _ in range(120):
            time.sleep(0.5)
            rows = {(r.queue_item_id, r.status, r.error_message) for r in sink.latest(spark, item_status.TABLE, schema, "queue_item_id").collect()}
            if {r[0] for r in rows} == items:
                return rows
        raise AssertionError(f"waited for {items}")

    try:
        until({20})
        time.sleep(6)  # several polls: the wait of run 1 is over
        add(spark, tmp_path, "links", LINKS, [(1, 10, 1, at(0)), (3, 30, 3, at(0))])
        time.sleep(3)
        add(spark, tmp_path, "changes", CHANGES, [(3, 3, "queued", None, None, "")])
        assert until({20, 30}) == {(20, "running", ""), (30, "queued", "")}  # the old change of run 1 is gone
    finally:
        query.stop()


def test_no_rows(spark, tmp_path):
    sink = sinks.BatchSink(f"{tmp_path}/out")
    add(spark, tmp_path, "changes", CHANGES, [])
    add(spark, tmp_path, "links", LINKS, [])
    item_status.sync_item_status(*streams(spark, tmp_path), sink, f"{tmp_path}/state").awaitTermination()
    assert sink.latest(spark, item_status.TABLE, spark.createDataFrame([], SCHEMA).schema, "queue_item_id").agg(F.count("*")).first()[0] == 0


def test_batches_keep_entries_in_few_tables_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    entries = item_status.RunEntries(f"{tmp_path}/entries")
    sink = sinks.BatchSink(f"{tmp_path}/out")
    on_batch = item_status.item_statuses(entries, sink)
    schema = spark.createDataFrame([], SCHEMA).schema
    links, changes = histories(seed=6)
    for nth in range(6):
        arrivals = item_status._arrivals(spark.createDataFrame(changes[nth::6], CHANGES), spark.createDataFrame(links[nth::6], LINKS))
        for _ in range(2 if nth in (2, 3) else 1):
            on_batch(arrivals, nth)
    done = sink.latest(spark, item_status.TABLE, schema, "queue_item_id")
    assert {tuple(r) for r in done.collect()} == expected(spark, links, changes)
    assert {p.name for p in (tmp_path / "entries" / "entries").iterdir()} == {"batch=3", "batch=4", "batch=5"}  # batch 5 holds 4 as well
    held = [spark.read.parquet(f"{tmp_path}/entries/entries/batch={nth}").select("run_id").collect() for nth in item_status.tables_before(6)]
    assert len(held) == 2 and {r.run_id for rows in held for r in rows} == {link[2] for link in links} | {999}


def test_no_python_is_called_per_run(spark, tmp_path):
    add(spark, tmp_path, "changes", CHANGES, [])
    add(spark, tmp_path, "links", LINKS, [])
    query = item_status.sync_item_status(*streams(spark, tmp_path), sinks.BatchSink(f"{tmp_path}/out"), f"{tmp_path}/state")
    query.awaitTermination()
    assert "PySpark" not in query._jsq.explainInternal(True)
