"""Latest and top-k rows per group.

All use ``row_number() <= k``, which Spark also applies per input partition before the shuffle, so a
group that holds most of the rows sends at most k of them per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.operators.filters import run_time

HEALTH_RUNS = 5


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(rank) <= k)


def latest_item_per_partition(items: DataFrame) -> DataFrame:
    """Newest item of every (queue, partition key)."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return top_per_group(items, ["queue_id", "partition_key"], newest, 1).drop("rank")


def _freshest() -> list[Column]:
    return [run_time().desc_nulls_last(), F.col("id").desc()]


def latest_run_per_job(runs: DataFrame) -> DataFrame:
    return top_per_group(runs, ["job_key"], _freshest(), 1).drop("rank")


def health_tiles(runs: DataFrame, k: int = HEALTH_RUNS) -> DataFrame:
    """The k newest runs of each job; ``rank`` 1 is the newest, shown last."""
    return top_per_group(runs, ["job_key"], _freshest(), k)


def capped_occurrences(ticks: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """First ``cap`` ticks of every schedule."""
    return top_per_group(ticks, keys, [F.col("tick").asc()], cap).drop("rank")


def event_tail(events: DataFrame, limit: int) -> DataFrame:
    """Last ``limit`` events of every run in ascending order, with the run's total."""
    totals = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    tail = top_per_group(events, ["run_id"], [F.col("id").desc()], limit).drop("rank")
    return tail.join(totals, "run_id")


def runs_of_jobs_in_order(runs: DataFrame) -> DataFrame:
    """Runs grouped by job, oldest first: one global sort, no per-job list."""
    return runs.orderBy("job_key", run_time(), "id")
