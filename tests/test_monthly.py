"""A purge rewrites the months it touches and leaves the files of all others as they are."""

import datetime as dt
import os

from pyspark.sql import functions as F

from flowledger.functions.times import literal_time
from flowledger.operators import monthly

RUNS = "id long, status string, completed_at timestamp, month string"
LINKS = "id long, run_id long, queue_item_id long, month string"


def files(path):
    return {os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_only_touched_months_are_rewritten(spark, tmp_path):
    days = [dt.datetime(2024, m, d) for m in range(1, 7) for d in (2, 20)]
    status = ["success", "failed", "running", "success"]
    runs = [(i, status[i % 4], day) for i, day in enumerate(days)] + [(100, "running", None)]
    table = lambda name, schema: monthly.MonthlyTable(str(tmp_path / name), spark.createDataFrame([], schema).schema)
    tables = {"runs": table("runs", RUNS), "queue_items": table("items", "id long, completed_at timestamp, month string")}
    by_run = "id long, run_id long, month string"
    tables |= {"run_steps": table("steps", by_run), "run_events": table("events", by_run)}
    tables |= {"queue_item_runs": table("links", LINKS), "queue_item_step_metadata": table("metadata", LINKS)}
    month = monthly.month_of(F.col("completed_at"))
    rows = spark.createDataFrame(runs, "id long, status string, completed_at timestamp").withColumn("month", month)
    tables["runs"].append(rows)
    hung = rows.select((F.col("id") * 10).alias("id"), F.col("id").alias("run_id"), "month")
    linked = hung.withColumn("queue_item_id", F.floor(F.col("run_id") / 2)).select("id", "run_id", "queue_item_id", "month")
    tables["run_steps"].append(hung)
    tables["run_events"].append(hung)
    tables["queue_item_runs"].append(linked)
    tables["queue_item_step_metadata"].append(linked)
    ended = linked.join(rows.select(F.col("id").alias("run_id"), "completed_at"), "run_id").groupBy(F.col("queue_item_id").alias("id")).agg(F.max("completed_at").alias("completed_at"))
    tables["queue_items"].append(ended.withColumn("month", month))
    before = files(tmp_path)

    def purge():
        monthly.purge_months(spark, tables, literal_time("2024-04-10 00:00:00"), 30)  # cutoff 11 March

    purge()
    after = files(tmp_path)
    old = {"2024-01", "2024-02", "2024-03"}
    same = {f for f in before if not any(f"month={m}" in f for m in old)}
    assert same and all(after.get(f) == before[f] for f in same)
    gone = {i for i, s, end in runs if end and end < dt.datetime(2024, 3, 11) and s in ("success", "failed", "canceled", "cancelled")}
    left = lambda name, column="id": {r[0] for r in tables[name].read(spark).select(column).collect()}
    assert gone and left("runs") == {i for i, *_ in runs} - gone
    for name in ("run_steps", "run_events", "queue_item_runs", "queue_item_step_metadata"):
        assert left(name, "run_id") == {i for i, *_ in runs} - gone
    # Item 0 lost both of its runs; the others have one that runs, or ended later.
    assert left("queue_items") == {i // 2 for i, *_ in runs} - {i // 2 for i in gone if {i // 2 * 2, i // 2 * 2 + 1} <= gone}
    purge()
    assert files(tmp_path) == after
    everything = files(tmp_path)
    monthly.purge_months(spark, tables, literal_time("2030-01-01 00:00:00"), 0)
    assert files(tmp_path) == everything


def test_months_that_are_empty_go(spark, tmp_path):
    table = monthly.MonthlyTable(str(tmp_path / "t"), spark.createDataFrame([], "id long, month string").schema)
    table.append(spark.createDataFrame([(1, "2024-01"), (2, "2024-02"), (3, "open")], "id long, month string"))
    gone = spark.createDataFrame([(1,), (9,), (None,)], "id long")
    table.remove(gone, "id")
    assert {tuple(r) for r in table.read(spark).collect()} == {(2, "2024-02"), (3, "open")}
    assert not os.path.exists(tmp_path / "t" / "month=2024-01")
    table.remove(spark.createDataFrame([], "id long"), "id")
    assert table.read(spark).count() == 2


def test_kept_rows_are_written_once(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(monthly, "materialize", lambda df, label: stored.append(label), raising=False)
    table = monthly.MonthlyTable(str(tmp_path / "t"), spark.createDataFrame([], "id long, note string, month string").schema)
    table.append(spark.createDataFrame([(i, f"n{i}", f"2024-0{1 + i % 3}") for i in range(30)], "id long, note string, month string"))
    table.remove(spark.createDataFrame([(i,) for i in (0, 0, 3, 1, None) + tuple(range(2, 30, 3))], "id long"), "id", "2024-03")
    assert not stored
    assert {tuple(r) for r in table.read(spark).collect()} == {(i, f"n{i}", f"2024-0{1 + i % 3}") for i in range(30) if i % 3 != 2 and i not in (0, 1, 3)}
    assert sorted(f for f in os.listdir(tmp_path / "t") if not f.startswith(("_", "."))) == ["month=2024-01", "month=2024-02"]
