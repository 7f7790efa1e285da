"""Queue ingestion: arrivals to items, items to runs, links, steps and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.params import queue_params, queue_trigger
from flowledger.functions.text import clean
from flowledger.operators.calendars import tasks
from flowledger.operators.joins import fan_out_items
from flowledger.operators.steps import split_by_partition_key
from flowledger.operators.store import QueuedRuns, insert_queued_runs, stable_key
from flowledger.session import discard, materialize
from flowledger.streaming.sinks import BatchSink


def ingest(arrivals: DataFrame, key: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Queue items from arrivals, and arrivals without a partition key.

    ``arrivals`` is (queue_id, queue_key, source_key, external_key, payload_json, queued_at);
    ``source_key`` names the arrival at its source, so a replay gives the same item. Every arrival
    gives one item: external keys and payloads may repeat. Payloads that are no JSON are rejected.
    """
    readable = F.try_parse_json("payload_json").isNotNull()
    good, no_key = split_by_partition_key(arrivals.filter(F.coalesce(readable, F.lit(False))), key)
    unreadable = arrivals.filter(~F.coalesce(readable, F.lit(False))).withColumn(
        "error", F.lit("payload is not valid json")
    )
    items = good.select(
        stable_key("qit_", F.col("queue_key"), F.col("source_key")).alias("queue_item_key"),
        "queue_id",
        "queue_key",
        "partition_key",
        F.lit("queued").alias("status"),
        clean(F.coalesce("external_key", F.lit(""))).alias("external_key"),
        "payload_json",
        F.lit("").alias("error_message"),
        F.coalesce("queued_at", now).alias("queued_at"),
        "source_key",
    )
    return items, no_key.unionByName(unreadable)


def broken_queues(queue_jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """queue_id of the queues with a job that has no nodes."""
    return queue_jobs.join(nodes.select("job_id"), "job_id", "left_anti").select("queue_id").distinct()


def fan_out(
    items: DataFrame, item_id: Column, queue_jobs: DataFrame, nodes: DataFrame, now: Column
) -> tuple[QueuedRuns, DataFrame, DataFrame]:
    """Runs, steps, events and links of new items; and the items that get none.

    An item is taken whole or not at all: where one job of its queue has no nodes, it is rejected.
    Run keys derive from item and job, so a replayed item starts no second run.
    """
    broken = broken_queues(queue_jobs, nodes)
    rejected = items.join(broken, "queue_id", "left_semi").withColumn("error", F.lit("job has no nodes"))
    wanted = fan_out_items(items.join(broken, "queue_id", "left_anti"), queue_jobs)
    requests = wanted.select(
        stable_key("run_", F.col("queue_item_key"), F.col("job_id").cast("string")).alias("run_key"),
        "queue_item_key",
        "job_id",
        queue_trigger(F.col("queue_key")).alias("triggered_by"),
        queue_params(
            F.col("queue_key"), item_id, F.col("partition_key"), F.col("external_key"), F.col("payload_json")
        ).alias("params_json"),
        "queued_at",
        F.lit(0).cast("long").alias("parent_run_id"),
        F.lit("").alias("rerun_step_key"),
        F.lit("").alias("error_message"),
        F.create_map(
            F.lit("queue_key"), F.col("queue_key"), F.lit("queue_item_id"), item_id.cast("string"),
            F.lit("partition_key"), F.col("partition_key"), F.lit("external_key"), F.col("external_key"),
        ).alias("event_payload"),
    )
    links = requests.select("queue_item_key", "job_id", "run_key")
    return insert_queued_runs(requests, nodes, now), links, rejected


def ingest_batches(
    sink: BatchSink, key: Column, now: Column, item_id: Column, queue_jobs: DataFrame, nodes: DataFrame
) -> Callable[[DataFrame, int], None]:
    """Batch function of the whole ingestion: five tables and the rejects, one commit.

    The queues' jobs, their nodes and the queues that can't run are written once at the start, so no batch scans the
    whole tables, and the planner knows that they are small: items never move to meet them. A batch's arrivals are spread
    over all tasks, however few files they come in, and its items are written before they fan out.
    """
    queue_jobs = materialize(queue_jobs.select("queue_id", "job_id", "sort_index"), "queue-jobs")
    nodes = materialize(nodes.join(queue_jobs.select("job_id").distinct(), "job_id", "left_semi"), "queue-nodes")
    unable = materialize(broken_queues(queue_jobs, nodes), "broken-queues")

    def on_batch(arrivals: DataFrame, batch_id: int) -> None:
        spread = arrivals.repartition(tasks(arrivals.sparkSession), "queue_key", "source_key").persist()
        try:
            items, rejected = ingest(spread, key, now)
            items = materialize(items, "ingested-items")
            queued, links, broken = fan_out(items, item_id, queue_jobs, nodes, now)
            kept = items.join(unable, "queue_id", "left_anti").select(*items.columns)
            sink.write(
                batch_id,
                items=kept,
                runs=queued.runs,
                steps=queued.steps,
                events=queued.events,
                links=links,
                rejected=rejected.select("source_key", "error").unionByName(broken.select("source_key", "error")),
            )
            discard(items)
        finally:
            spread.unpersist()

    return on_batch
