"""Equi-joins between history tables.

No broadcast hints: the planner broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs_with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    names = jobs.select(F.col("id").alias("job_id"), "job_key", F.col("display_name").alias("job_display_name"))
    return runs.join(names, "job_id")


def items_with_queues(items: DataFrame, queues: DataFrame) -> DataFrame:
    names = queues.select(
        F.col("id").alias("queue_id"), "queue_key", F.col("display_name").alias("queue_display_name")
    )
    return items.join(names, "queue_id")


def links_with_runs(links: DataFrame, runs: DataFrame) -> DataFrame:
    """Linked runs of every item with the columns of the run."""
    run_columns = runs.select(
        F.col("id").alias("run_id"),
        "run_key",
        F.col("status").alias("run_status"),
        "triggered_by",
        "queued_at",
        "started_at",
        "completed_at",
        "parent_run_id",
        "rerun_step_key",
        F.col("error_message").alias("run_error_message"),
    )
    return links.join(run_columns, "run_id")


def item_runs(links: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Linked runs of every item with run and job columns."""
    return runs_with_jobs(links_with_runs(links, runs), jobs)


def without_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items no run is linked to."""
    return items.join(links.select(F.col("queue_item_id").alias("id")), "id", "left_anti")


def metadata_with_job_key(metadata: DataFrame, links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Step metadata with the key of its job, or ``job`` where the item has no run of that job."""
    linked = links.select("queue_item_id", "job_id").distinct()
    names = linked.join(jobs.select(F.col("id").alias("job_id"), "job_key"), "job_id")
    return metadata.join(names, ["queue_item_id", "job_id"], "left").withColumn(
        "job_key", F.coalesce("job_key", F.lit("job"))
    )


def node_status(runs: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Status of every graph node of every run; nodes without a step row are pending.

    ``runs`` is (run_id, job_id).
    """
    status = steps.select("run_id", "step_key", "status")
    return (
        runs.select("run_id", "job_id")
        .join(nodes.select("job_id", "step_key"), "job_id")
        .join(status, ["run_id", "step_key"], "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    )


def quiet_jobs(jobs: DataFrame, runs_in_window: DataFrame) -> DataFrame:
    """Jobs without a run among ``runs_in_window`` (which carries job_key)."""
    return jobs.join(runs_in_window.select("job_key").distinct(), "job_key", "left_anti")


def fan_out_items(items: DataFrame, queue_jobs: DataFrame) -> DataFrame:
    """One row per (item, attached job)."""
    attached = queue_jobs.select("queue_id", "job_id", "sort_index")
    return items.join(attached, "queue_id")


def fan_out_steps(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One pending step per (run, node). ``runs`` is (run_id, job_id, ...)."""
    return runs.select("run_id", "job_id").join(nodes.select("job_id", "step_key", "sort_index"), "job_id").select(
        "run_id",
        "step_key",
        "sort_index",
        F.lit("pending").alias("status"),
        F.lit(1).cast("long").alias("attempt"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.lit("{}").alias("output_json"),
        F.lit("").alias("error_message"),
    )


def parent_outputs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Outputs a rerun inherits: the successful steps of its parent run, status matched as stored."""
    reruns = runs.filter("parent_run_id > 0").select(F.col("id").alias("run_id"), "parent_run_id")
    produced = steps.filter(F.col("status") == "success").select(
        F.col("run_id").alias("parent_run_id"), "step_key", "output_json"
    )
    return reruns.join(produced, "parent_run_id")


def unoccupied_ticks(ticks: DataFrame, occupied: DataFrame) -> DataFrame:
    """Scheduled ticks of minutes in which the job has no run. Both sides carry (job_key, minute)."""
    return ticks.join(occupied.select("job_key", "minute").distinct(), ["job_key", "minute"], "left_anti")


def only_active(records: DataFrame, active: DataFrame) -> DataFrame:
    """Schedule state or claims whose schedule is still active; runs are never touched."""
    keys = active.select("job_key", "schedule_key").distinct()
    return records.join(keys, ["job_key", "schedule_key"], "left_semi")


def touched_links(links: DataFrame, changed_runs: DataFrame) -> DataFrame:
    """All links of every item that one of ``changed_runs`` (run_id) belongs to."""
    items = links.join(changed_runs.select("run_id"), "run_id", "left_semi").select("queue_item_id").distinct()
    return links.join(items, "queue_item_id", "left_semi")
