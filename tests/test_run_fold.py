"""Event-log fold with bounded state: equal to the fold of the whole table over restarts, state of ended runs gone, late events defined."""

import datetime as dt
import random

from flowledger.streaming import fold, run_fold, sinks

EVENTS = "id long, run_id long, step_key string, event_type string, event_data_json string, created_at timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def history(runs, seed=3):
    """Events of runs that start an hour apart: steps that start, fail or succeed, a second end for some, and runs left open."""
    rng, out = random.Random(seed), []
    for run in runs:
        events = [("", "run_queued", None), ("", "run_started", None)]
        for step in range(rng.randrange(4)):
            events += [(f"s{step}", "step_started", None), (f"s{step}", rng.choice(["step_succeeded", "step_failed"]), None)]
        if run % 5:
            events += [("", "run_completed", '{"status": "success"}')] + [("", "run_failed", None)] * (run % 3 == 0)
        out += [(1000 * run + n, run, step, kind, data, at(run + n / 60)) for n, (step, kind, data) in enumerate(events)]
    return out


class Stream:
    def __init__(self, spark, folder, late="3 hours"):
        self.spark, self.folder, self.late, self.files = spark, folder, late, 0
        self.sink, self.seen = sinks.BatchSink(f"{folder}/out"), []

    def add(self, rows):
        """A drain over new files, as a restart of the query."""
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.seen += rows
        source = sinks.table_stream(self.spark, self.spark.createDataFrame([], EVENTS).schema, f"{self.folder}/in", files_per_batch=1)
        run_fold.sync_run_states(source, self.sink, f"{self.folder}/state", self.late).awaitTermination()

    def states(self):
        entries = run_fold.read_entries(self.spark, self.sink)
        return {tuple(r) for r in run_fold.run_states(entries).collect()}, {tuple(r) for r in run_fold.step_states(entries).collect()}

    def expected(self, rows=None):
        table = self.spark.createDataFrame(self.seen if rows is None else rows, EVENTS)
        return {tuple(r) for r in fold.run_states(table).collect()}, {tuple(r) for r in fold.step_states(table).collect()}

    def runs_in_state(self):
        state = self.spark.read.format("statestore").option("stateVarName", "entries").load(f"{self.folder}/state")
        return {r[0] for r in state.select("key.run_id").distinct().collect()}


def test_state_of_ended_runs_goes_and_later_events_merge(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    for first in (0, 20, 40):  # each part is hours later than the one before
        stream.add(history(range(first, first + 20)))
        assert stream.states() == stream.expected()
    stream.add([(99_000, 99, "", "run_queued", None, at(99))])
    stream.add([(99_001, 99, "", "run_started", None, at(99.1))])
    assert stream.states() == stream.expected()
    assert stream.runs_in_state() == {r for r in range(60) if r % 5 == 0} | {99}
    # a new event of a cleared run changes no end, and one behind the watermark isn't counted
    before = list(stream.seen)
    new = [(41_900, 41, "", "run_started", None, at(99.2)), (41_901, 41, "s9", "step_started", None, at(99.2))]
    stream.add([*new, (42_900, 42, "", "run_canceled", None, at(42.9)), (50_900, 50, "s0", "step_failed", None, at(60))])
    assert stream.states() == stream.expected(before + new)
    assert next(r for r in stream.states()[0] if r[0] == 41)[1] == "success"


def test_no_events(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.add([])
    assert stream.states() == (set(), set())
    stream.add([(1, None, "", "run_started", None, at(0)), (2, 1, None, "run_started", None, at(0)), (3, 1, "", "note", None, at(1)), (4, 1, "", "run_completed", "no json", at(1))])
    assert stream.states()[0] == {(1, "running", at(0), None)}
