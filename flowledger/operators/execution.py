"""What happens to the steps of a run: readiness, skips, reruns, cancellation.

``steps`` is (run_id, step_key, status, ...); ``edges`` is keyed by run_id here, that is, the job's
edges joined to its runs with ``run_edges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.status import exec_status
from flowledger.functions.times import step_duration_ms
from flowledger.operators.joins import parent_outputs
from flowledger.operators.layers import reached_from

STEP = ["run_id", "step_key"]
# Messages written with a skipped step.
SKIPPED_BY_DEPENDENCY = "dependency output unavailable"
SKIPPED_BY_RERUN = "rerun skipped"


def run_edges(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of every run from the edges of its job. ``runs`` is (run_id, job_id)."""
    return runs.select("run_id", "job_id").join(edges, "job_id").select("run_id", "from_step_key", "to_step_key")


def ready_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending steps all of whose dependencies succeeded."""
    status = steps.select("run_id", F.col("step_key").alias("from_step_key"), F.col("status").alias("from_status"))
    blocked = (
        edges.join(status, ["run_id", "from_step_key"])
        .groupBy("run_id", F.col("to_step_key").alias("step_key"))
        .agg(F.bool_and(F.col("from_status") == "success").alias("met"))
        .filter("not met")
    )
    return steps.filter("status = 'pending'").join(blocked, STEP, "left_anti").select(*STEP)


def skipped_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending steps that can no longer run because a step upstream did not succeed.

    A skip travels only along edges that end in a pending step; chains of any length cost a logarithm of rounds.
    """
    ended, waits = exec_status(F.col("status")).isin("failed", "canceled", "skipped"), F.col("status") == "pending"
    state = steps.select(*STEP, ended.alias("hit"), waits.alias("waits")).filter("hit or waits")
    # Only edges from a step that is, or can become, skipped to a pending one matter.
    pending = state.filter("waits").select("run_id", F.col("step_key").alias("to_step_key"))
    sources = state.select("run_id", F.col("step_key").alias("from_step_key"), "hit")
    paths = edges.join(pending, ["run_id", "to_step_key"], "left_semi").join(sources, ["run_id", "from_step_key"])
    return reached_from(paths, "run_id").withColumns({"status": F.lit("skipped"), "error_message": F.lit(SKIPPED_BY_DEPENDENCY)})


def rerun_plan(runs: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """What each step of a rerun does: the target runs, all others are skipped.

    The target is skipped too when a dependency left no successful output in the parent run.
    ``runs`` has (id, parent_run_id, rerun_step_key); ``steps`` covers reruns and their parents.
    """
    reruns = runs.filter("rerun_step_key <> ''").select(F.col("id").alias("run_id"), "rerun_step_key", "parent_run_id")
    inherited = parent_outputs(runs, steps).select("run_id", F.col("step_key").alias("from_step_key"))
    targets = reruns.select("run_id", F.col("rerun_step_key").alias("to_step_key"))
    starved = (
        edges.join(targets, ["run_id", "to_step_key"], "left_semi")
        .join(inherited, ["run_id", "from_step_key"], "left_anti")
        .select("run_id")
        .distinct()
        .withColumn("starved", F.lit(True))
    )
    is_target = F.col("step_key") == F.col("rerun_step_key")
    return (
        steps.select(*STEP)
        .join(reruns.select("run_id", "rerun_step_key"), "run_id")
        .join(starved, "run_id", "left")
        .select(
            *STEP,
            F.when(is_target & F.col("starved").isNull(), F.lit("run")).otherwise(F.lit("skipped")).alias("action"),
            F.when(~is_target, F.lit(SKIPPED_BY_RERUN))
            .when(F.col("starved"), F.lit(SKIPPED_BY_DEPENDENCY))
            .otherwise(F.lit(""))
            .alias("reason"),
        )
    )


def canceled_steps(canceled_runs: DataFrame, steps: DataFrame, now: Column, message: str) -> DataFrame:
    """Steps of canceled runs that had not finished, as they stand after the cancellation."""
    open_step = ~exec_status(F.col("status")).isin("success", "failed", "skipped", "canceled")
    return (
        steps.join(canceled_runs.select("run_id"), "run_id", "left_semi")
        .filter(open_step)
        .select(
            *STEP,
            F.lit("canceled").alias("status"),
            now.alias("completed_at"),
            step_duration_ms(F.col("duration_ms"), F.col("started_at"), now).alias("duration_ms"),
            F.coalesce(F.nullif(F.trim("output_json"), F.lit("")), F.lit("{}")).alias("output_json"),
            F.lit(message).alias("error_message"),
            F.lit("step canceled").alias("log_excerpt"),
        )
    )
