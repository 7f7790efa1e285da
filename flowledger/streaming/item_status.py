"""Queue item status kept up to date over two streams: links of runs to items, and changes of runs.

``links`` is (id, queue_item_id, run_id, created_at), one per run. ``changes`` is (run_id, change_id, status,
started_at, completed_at, error_message) with the status normalised; a higher ``change_id`` is a later change. Either may
come first.

Each batch is joined to what the batches before left: per run its link and its latest change. Runs whose link and change
are both known, and one of them new, name their items, and only those items are rolled up again, so a run or an item may
come back in any batch and an item may have any number of runs. A change that waits for its link is forgotten after a
stated time, if one is given.

The entries of runs lie in the checkpoint folder, a table per batch with the runs that it touched. Every second table
takes in the one before, every fourth the three before, and so on: n batches leave at most log2(n) + 1 tables to read, and an
entry is written at most so many times again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowledger.operators.counts import item_lifecycle
from flowledger.operators.latest import top_per_group
from flowledger.streaming.sinks import BatchSink, run_stream

TABLE = "item_status"

LINK = "struct<id: bigint, queue_item_id: bigint, linked_at: timestamp>"
CHANGE = "struct<change_id: bigint, status: string, started_at: timestamp, completed_at: timestamp, error_message: string>"
ENTRY = f"run_id long, link {LINK}, change {CHANGE}, waits_since timestamp"


def _arrivals(changes: DataFrame, links: DataFrame) -> DataFrame:
    """Links and changes as rows of one stream: (run_id, link, change), one of the two null."""
    link = F.struct("id", "queue_item_id", F.col("created_at").alias("linked_at")).cast(LINK)
    change = F.struct("change_id", "status", "started_at", "completed_at", "error_message").cast(CHANGE)
    link_rows = links.filter("queue_item_id is not null").select("run_id", link.alias("link"), F.lit(None).cast(CHANGE).alias("change"))
    change_rows = changes.select("run_id", F.lit(None).cast(LINK).alias("link"), change.alias("change"))
    return link_rows.unionByName(change_rows).withColumn("run_id", F.col("run_id").cast("long")).filter("run_id is not null")


def tables_before(batch_id: int) -> list[int]:
    """Batches whose tables together hold the entries of all batches before ``batch_id``, newest first."""
    found = []
    while batch_id:
        found.append(batch_id - 1)
        batch_id &= batch_id - 1
    return found


def taken_in(batch_id: int) -> list[int]:
    """Earlier batches whose tables the table of ``batch_id`` replaces."""
    return [nth for nth in tables_before(batch_id) if nth >= batch_id & (batch_id + 1)]


class RunEntries:
    """Link and latest change of every run, as tables by batch; a repeated batch reads what it read the first time."""

    def __init__(self, folder: str, wait_ms: int | None = None):
        self.tables = BatchSink(folder)
        self.wait_ms = wait_ms

    def _read(self, spark: SparkSession, batches: list[int], touched: DataFrame | None, batch_id: int) -> DataFrame:
        """Entries of the tables of ``batches`` and those ``touched`` by this batch, with the batch; a run may be in several."""
        parts = [spark.read.schema(ENTRY).parquet(f"{self.tables.folder}/entries/batch={nth}").withColumn("batch", F.lit(nth)) for nth in batches]
        if touched is not None:
            parts.append(touched.drop("announced").withColumn("batch", F.lit(batch_id)))
        return reduce(DataFrame.unionByName, parts)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return top_per_group(rows, ["run_id"], [F.col("batch").desc()], 1).drop("rank", "batch")

    def _not_forgotten(self, rows: DataFrame, now: Column) -> DataFrame:
        if self.wait_ms is None:
            return rows
        waited = F.unix_millis(now) - F.unix_millis("waits_since")
        return rows.filter(F.col("link").isNotNull() | (waited <= self.wait_ms))

    def update(self, arrivals: DataFrame, batch_id: int) -> DataFrame:
        """Take in a batch: the entries of all runs of the items that it changes."""
        spark, before, now = arrivals.sparkSession, tables_before(batch_id), F.lit(dt.datetime.now(dt.timezone.utc))
        self._drop(spark, batch_id - 1)
        arrived = arrivals.groupBy("run_id").agg(F.min("link").alias("new_link"), F.max("change").alias("new_change"))
        if before:
            known = self._read(spark, before, None, batch_id).join(arrived.select("run_id"), "run_id", "left_semi")
            known = self._not_forgotten(self._newest(known), now)
        else:
            known = spark.createDataFrame([], ENTRY)
        first = F.col("change").isNull() & F.col("new_change").isNotNull()
        moved = first | F.coalesce(F.col("new_change.change_id") > F.col("change.change_id"), F.lit(False))
        change, link = F.when(moved, F.col("new_change")).otherwise(F.col("change")), F.coalesce("link", "new_link")
        touched = arrived.join(known, "run_id", "left").select(
            "run_id", link.alias("link"), change.alias("change"),
            F.when(link.isNull(), F.when(moved, now).otherwise(F.col("waits_since"))).alias("waits_since"),
            (link.isNotNull() & change.isNotNull() & (moved | F.col("link").isNull())).alias("announced"),
        )
        older = taken_in(batch_id)
        touched = self.tables.put(batch_id, "touched" if older else "entries", touched)
        if older:
            merged = self._newest(self._read(spark, older, touched, batch_id))
            self.tables.put(batch_id, "entries", self._not_forgotten(merged, now))
        items = touched.filter("announced").select(F.col("link.queue_item_id").alias("queue_item_id")).distinct()
        linked = self._read(spark, before, touched, batch_id).filter("link is not null and change is not null")
        named = linked.withColumn("queue_item_id", F.col("link.queue_item_id")).join(items, "queue_item_id", "left_semi")
        return self._newest(named) if before else named

    def _drop(self, spark: SparkSession, batch_id: int) -> None:
        """Delete what a finished batch has replaced."""
        for name, nth in [("touched", batch_id), *[("entries", nth) for nth in taken_in(batch_id)]] if batch_id > 0 else []:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.tables.folder}/{name}/batch={nth}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def item_statuses(entries: RunEntries, sink: BatchSink) -> Callable[[DataFrame, int], None]:
    """Batch function: queue_item_id, status, started_at, completed_at, error_message of every item that the batch changes."""

    def on_batch(arrivals: DataFrame, batch_id: int) -> None:
        runs = entries.update(arrivals, batch_id).select(
            "queue_item_id", "link.id", F.col("link.linked_at").alias("created_at"), F.coalesce("change.status", F.lit("")).alias("run_status"),
            "change.started_at", "change.completed_at", F.col("change.error_message").alias("run_error_message"),
        )
        sink.write(batch_id, **{TABLE: item_lifecycle(runs)})

    return on_batch


def sync_item_status(
    changes: DataFrame,
    links: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    poll_every: str | None = None,
    wait_ms: int | None = None,
) -> StreamingQuery:
    """Write the status of every item whose runs or links changed to ``item_status`` of ``sink``.

    ``wait_ms`` needs ``poll_every``: a query that drains and ends leaves no time to wait in.
    """
    if wait_ms is not None and not poll_every:
        raise ValueError("wait_ms needs poll_every")
    entries = RunEntries(f"{checkpoint.rstrip('/')}/run-entries", wait_ms)
    return run_stream(_arrivals(changes, links), checkpoint, item_statuses(entries, sink), poll_every)
