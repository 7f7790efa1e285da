"""Event-log fold with bounded state: the state of a run and its steps goes a stated time after the run has ended.

``events`` is (id, run_id, step_key, event_type, event_data_json, created_at). One stateful operator, keyed by run, keeps an entry
for the run itself (step key ``''``) and one per step, and hands on the entries that a batch touched. When the
watermark passes the run's end by the stated lateness, a timer clears the run.

Later events have a defined answer. One that is older than the watermark, that is, behind the newest event by more than
the lateness, is not counted. A newer one that belongs to a cleared run begins new entries, which readers merge with the old
ones: the first end of a run still decides, as if nothing had been cleared. Runs that don't end keep their state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from flowledger.streaming.fold import ENDED_STEP_EVENTS, TERMINAL_RUN_EVENTS, event_state, updates_to
from flowledger.streaming.sinks import BatchSink, run_stream

TABLE = "run_fold"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 day"
ENTRY = "ended_id long, ended_status string, ended_at long, last_id long, last_status string, started_at long, completed_at long"
FOLDED = f"run_id long, step_key string, {ENTRY}"
FOLDED_ROW = Row(*(field.split()[0] for field in FOLDED.split(", ")))


class FoldRuns(StatefulProcessor):
    """Per run: an entry for itself and for each step, until it has been over for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "step_key string", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        touched: dict[str, list] = {}
        for row in rows:
            if row.step_key not in touched:
                kept = self.entries.getValue((row.step_key,))
                touched[row.step_key] = list(kept) if kept is not None else [None] * 7
            entry, at = touched[row.step_key], row.at
            if row.ends and (entry[0] is None or row.id < entry[0]):
                entry[0:3] = row.id, row.state, at
            if entry[3] is None or row.id > entry[3]:
                entry[3:5] = row.id, row.state
            if row.starts and (entry[5] is None or at < entry[5]):
                entry[5] = at
            if row.ends and (entry[6] is None or at > entry[6]):
                entry[6] = at
        for step, entry in touched.items():
            self.entries.updateValue((step,), tuple(entry))
            yield FOLDED_ROW(key[0], step, *entry)
        run = touched.get("")
        if run and run[6] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(run[6] // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass


def folded(events: DataFrame, late: str = LATE) -> DataFrame:
    """The entries of runs and steps, a row per entry and batch that touches it; :func:`run_states` and :func:`step_states` read them."""
    kind = F.col("event_type")
    rows = events.withWatermark("created_at", late).select(
        F.col("run_id").cast("long").alias("run_id"),
        F.coalesce("step_key", F.lit("")).alias("step_key"),
        F.col("id").cast("long").alias("id"),
        event_state().alias("state"),
        kind.isin("run_started", "step_started").alias("starts"),
        kind.isin(*TERMINAL_RUN_EVENTS, *ENDED_STEP_EVENTS).alias("ends"),
        "created_at",
        F.unix_micros("created_at").alias("at"),
    )
    rows = rows.filter("state is not null and run_id is not null and id is not null and at is not null")
    keep = events.sparkSession.sql(f"select interval '{late}' as i").select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.col("i"))).first()[0]
    return rows.groupBy("run_id").transformWithState(FoldRuns(keep), FOLDED, "update", "eventTime")


def sync_run_states(events: DataFrame, sink: BatchSink, checkpoint: str, late: str = LATE, poll_every: str | None = None) -> StreamingQuery:
    """Write the entries of every run that events touched to ``run_fold`` of ``sink``."""
    conf = events.sparkSession.conf
    before = conf.get(STORE_CONF, None)
    conf.set(STORE_CONF, STORE)  # a query takes the settings that hold when it starts
    try:
        return run_stream(folded(events, late), checkpoint, updates_to(sink, TABLE), poll_every, mode="update")
    finally:
        if before is None:
            conf.unset(STORE_CONF)
        else:
            conf.set(STORE_CONF, before)


def merged(rows: DataFrame) -> DataFrame:
    """One entry per run and step out of all that were written, older and newer ones and those before and after a run was cleared."""
    return rows.groupBy("run_id", "step_key").agg(
        F.min_by("ended_status", "ended_id").alias("ended_status"),
        F.min_by("ended_at", "ended_id").alias("ended_at"),
        F.max_by("last_status", "last_id").alias("last_status"),
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
    )


def read_entries(spark: SparkSession, sink: BatchSink) -> DataFrame:
    return merged(sink.read(spark, TABLE, spark.createDataFrame([], FOLDED).schema))


def run_states(entries: DataFrame) -> DataFrame:
    """State of every run: its first terminal event decides, before that its latest event."""
    return entries.filter("step_key = ''").select(
        "run_id",
        F.coalesce("ended_status", "last_status").alias("status"),
        F.timestamp_micros("started_at").alias("started_at"),
        F.timestamp_micros("ended_at").alias("completed_at"),
    )


def step_states(entries: DataFrame) -> DataFrame:
    """State of every step: its latest event decides."""
    return entries.filter("step_key <> ''").select(
        "run_id", "step_key", F.col("last_status").alias("status"),
        F.timestamp_micros("started_at").alias("started_at"), F.timestamp_micros("completed_at").alias("completed_at"),
    )
