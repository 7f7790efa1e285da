"""Counts and rollups. Every aggregate here combines on the map side, so one hot key costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions.events import event_level
from flowledger.functions.status import display_status, exec_status, is_active, status_rank, step_group
from flowledger.functions.times import millis
from flowledger.operators.filters import QUICK_FILTERS, quick_filter

STEP_COUNTERS = ("pending", "running", "success", "failed", "skipped", "canceled")
ITEM_COUNTERS = ("queued", "running", "complete", "failed")


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def count_by(rows: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    """Rows per key, for every key at once; without keys, one total."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def partitions_per_queue(items: DataFrame) -> DataFrame:
    return items.groupBy("queue_id").agg(F.count_distinct("partition_key").alias("partitions"))


def distinct_schedules(claims: DataFrame) -> DataFrame:
    return claims.select("job_key", "schedule_key").distinct()


def step_counts(steps: DataFrame) -> DataFrame:
    """Steps of each run by stored status, matched exactly."""
    return steps.groupBy("run_id").agg(*[_count(F.col("status") == s, f"{s}_steps") for s in STEP_COUNTERS])


def run_summary(runs_with_job: DataFrame, steps: DataFrame) -> DataFrame:
    """Every run with its step counts; runs without steps count zero."""
    counts = step_counts(steps).withColumnRenamed("run_id", "id")
    zero = F.lit(0).cast("long")
    joined = runs_with_job.join(counts, "id", "left")
    return joined.withColumns({f"{s}_steps": F.coalesce(F.col(f"{s}_steps"), zero) for s in STEP_COUNTERS})


def item_lifecycle(linked_runs: DataFrame) -> DataFrame:
    """Status, start, end and error of each queue item, rolled up over its linked runs.

    ``linked_runs`` is (queue_item_id, id, created_at, run_status, started_at, completed_at,
    run_error_message). The error is the first non-empty one in link order.
    """
    status = exec_status(F.col("run_status"))
    has_error = F.col("run_error_message") != ""
    seen = linked_runs.groupBy("queue_item_id").agg(
        F.bool_and(status == "queued").alias("all_queued"),
        F.bool_or(status.isin("queued", "running")).alias("any_open"),
        F.bool_and(status == "success").alias("all_success"),
        F.min("started_at").alias("first_start"),
        F.max("completed_at").alias("last_end"),
        F.min_by(
            F.when(has_error, F.col("run_error_message")), F.when(has_error, F.struct("created_at", "id"))
        ).alias("first_error"),
    )
    rolled = (
        F.when(F.col("all_queued"), F.lit("queued"))
        .when(F.col("any_open"), F.lit("running"))
        .when(F.col("all_success"), F.lit("complete"))
        .otherwise(F.lit("failed"))
    )
    return seen.select(
        "queue_item_id",
        rolled.alias("status"),
        F.col("first_start").alias("started_at"),
        F.when(rolled.isin("complete", "failed"), F.col("last_end")).alias("completed_at"),
        F.when(rolled == "complete", F.lit("")).otherwise(F.coalesce("first_error", F.lit(""))).alias("error_message"),
    )


def queue_summary(queues: DataFrame, items: DataFrame) -> DataFrame:
    """Items, partitions and status counts of every queue; other statuses count only as items.

    Items are first reduced to (queue, partition, status) counts, so a hot queue is spread over its
    partitions before anything is gathered per queue.
    """
    small = items.groupBy("queue_id", "partition_key").agg(
        F.count(F.lit(1)).alias("n"), *[_count(F.col("status") == s, s) for s in ITEM_COUNTERS]
    )
    counts = small.groupBy(F.col("queue_id").alias("id")).agg(
        F.sum("n").alias("item_count"),
        F.count("partition_key").alias("partition_count"),
        *[F.sum(s).alias(f"{s}_count") for s in ITEM_COUNTERS],
    )
    names = ["item_count", "partition_count", *[f"{s}_count" for s in ITEM_COUNTERS]]
    zero = F.lit(0).cast("long")
    return queues.join(counts, "id", "left").withColumns({n: F.coalesce(F.col(n), zero) for n in names})


def queue_totals(summary: DataFrame) -> DataFrame:
    named = {"items": "item_count", "partitions": "partition_count"} | {s: f"{s}_count" for s in ITEM_COUNTERS}
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in named.items()])


def quick_counts(runs: DataFrame) -> DataFrame:
    """How many runs each quick filter would keep; a run may count in several."""
    return runs.agg(*[_count(quick_filter(f, F.col("status"), F.col("triggered_by")), f) for f in QUICK_FILTERS])


def group_counts(node_status: DataFrame) -> DataFrame:
    """Nodes per step group of every run."""
    grouped = node_status.withColumn("step_group", step_group(F.col("status")))
    return grouped.groupBy("run_id", "step_group").agg(F.count(F.lit(1)).alias("steps"))


def group_members(node_status: DataFrame) -> DataFrame:
    """Step keys of every group of every run, one per row."""
    return node_status.select("run_id", step_group(F.col("status")).alias("step_group"), "step_key")


def item_metadata(metadata_with_job: DataFrame) -> DataFrame:
    """Metadata map of each (item, job_key, step_key); text that is no JSON object gives an empty map.

    One row per cell, not one nested map per item: an item may have any number of steps. Where
    several jobs fall back to the same key, the last by (job_id, id) wins.
    """
    parsed = F.try_parse_json("metadata_json")
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    last = metadata_with_job.groupBy("queue_item_id", "job_key", "step_key").agg(
        F.max_by("metadata_json", F.struct("job_id", "id")).alias("metadata_json")
    )
    return last.withColumn("metadata_json", F.when(is_object, F.to_json(parsed)).otherwise(F.lit("{}")))


def event_levels(events: DataFrame) -> DataFrame:
    """Distinct levels of each run's events, blanks dropped."""
    level = event_level(F.col("level"))
    return events.select("run_id", level.alias("level")).filter("level <> ''").distinct()


def run_statuses(runs: DataFrame) -> DataFrame:
    """Distinct display statuses in display order."""
    shown = runs.select(display_status(F.col("status")).alias("status")).distinct()
    return shown.withColumn("rank", status_rank(F.col("status"))).orderBy("rank", "status")


def run_outcome(steps_in_order: DataFrame, order: str = "topo_key") -> DataFrame:
    """Outcome of each run from its steps: failed if any failed, with the first failure's message.

    ``order`` is the column that gives execution order within the run.
    """
    failed = F.col("status") == "failed"
    return steps_in_order.groupBy("run_id").agg(
        F.when(F.bool_or(failed), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.coalesce(
            F.min_by(F.when(failed, F.col("error_message")), F.when(failed, F.col(order))), F.lit("")
        ).alias("error_message"),
    )


def jobs_of_queues(queue_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of every queue, one per row; ``sort_index`` gives the declared order."""
    names = jobs.select(F.col("id").alias("job_id"), "job_key", "display_name")
    return queue_jobs.join(names, "job_id").select(
        "queue_id", "sort_index", "job_key", "display_name"
    )


def schedules_of_jobs(schedules: DataFrame) -> DataFrame:
    """Schedules and enabled schedules per job."""
    return schedules.groupBy("job_key").agg(
        F.count(F.lit(1)).alias("schedules"), F.count_if(F.col("is_enabled")).alias("enabled_schedules")
    )


def overview_stats(
    runs: DataFrame, runs_in_window: DataFrame, schedules: DataFrame, quiet: DataFrame
) -> DataFrame:
    """One row of overview numbers. Each input gives one partial row; their sum is the answer."""
    names = (
        "running_now", "failed_in_window", "success_in_window", "total_runs_in_window", "enabled_schedules", "quiet_jobs"
    )
    shown = display_status(F.col("status"))

    def partial(rows: DataFrame, **counts: Column) -> DataFrame:
        one = rows.agg(*[c.alias(n) for n, c in counts.items()])
        return one.select(*[F.col(n) if n in counts else F.lit(0).cast("long").alias(n) for n in names])

    parts = (
        partial(runs, running_now=F.count_if(is_active(F.col("status"))))
        .unionByName(
            partial(
                runs_in_window,
                failed_in_window=F.count_if(shown == "failed"),
                success_in_window=F.count_if(shown == "success"),
                total_runs_in_window=F.count(F.lit(1)),
            )
        )
        .unionByName(partial(schedules, enabled_schedules=F.count_if(F.col("is_enabled"))))
        .unionByName(partial(quiet, quiet_jobs=F.count(F.lit(1))))
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def queue_latency(runs: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Mean and exact percentiles of the wait from queued to started, in ms, per job.

    Two passes keep every task bounded: a histogram by minute finds the minute that holds each
    percentile, then only the values inside that minute (60,000 at most) are ordered. The
    percentile is the smallest value with at least that share of values at or below it.
    """
    waits = runs.filter("started_at is not null and queued_at is not null").select(
        "job_id", (millis(F.col("started_at")) - millis(F.col("queued_at"))).alias("ms")
    )
    values = waits.groupBy("job_id", "ms").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("minute", F.floor(F.col("ms") / 60000))
    minutes = values.groupBy("job_id", "minute").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ms")).alias("ms"))
    before = Window.partitionBy("job_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("job_id")
    placed = minutes.select(
        "job_id",
        "minute",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
        F.sum("n").over(whole).alias("total"),
    )
    totals = minutes.groupBy("job_id").agg(
        F.sum("n").alias("started_runs"), F.round(F.sum("ms") / F.sum("n"), 3).alias("mean_ms")
    )
    answer = totals
    for share in percentiles:
        name = f"p{round(share * 100)}_ms"
        rank = F.ceil(F.col("total") * F.lit(share))
        holder = placed.filter((F.col("below") < rank) & (rank <= F.col("below") + F.col("n"))).select(
            "job_id", "minute", (rank - F.col("below")).alias("rank")
        )
        inside = Window.partitionBy("job_id").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
        picked = (
            values.join(holder, ["job_id", "minute"])
            .withColumn("upto", F.sum("n").over(inside))
            .filter(F.col("upto") >= F.col("rank"))
            .groupBy("job_id")
            .agg(F.min("ms").alias(name))
        )
        answer = answer.join(picked, "job_id")
    return answer


