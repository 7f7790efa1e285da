"""Row predicates of the run, event, job and queue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.functions.events import event_level, in_stream
from flowledger.functions.status import display_status, step_group
from flowledger.functions.text import all_of, contains_any_case
from flowledger.functions.times import effective_time

# Stored spellings of a finished run that retention accepts.
PURGEABLE = ("success", "failed", "canceled", "cancelled")
QUICK_FILTERS = ("all", "backfills", "queued", "in_progress", "failed", "scheduled")


def purgeable(completed_at: Column, status: Column, cutoff: Column) -> Column:
    """Finished before the cutoff. The stored status is matched as is."""
    return completed_at.isNotNull() & (completed_at < cutoff) & status.isin(*PURGEABLE)


def quick_filter(name: str, status: Column, triggered_by: Column) -> Column:
    shown = display_status(status)
    origin = F.lower(F.coalesce(triggered_by, F.lit("")))
    conditions = {
        "all": F.lit(True),
        "backfills": F.contains(origin, F.lit("backfill")),
        "queued": shown.isin("queued", "pending"),
        "in_progress": shown == "running",
        "failed": shown == "failed",
        "scheduled": F.contains(origin, F.lit("schedule")),
    }
    return conditions[name]


def run_time() -> Column:
    return effective_time(F.col("started_at"), F.col("queued_at"), F.col("completed_at"))


def filter_runs(
    runs: DataFrame,
    now: Column,
    quick: str = "all",
    job_key: str | None = None,
    status: str | None = None,
    last_hours: int = 0,
    text: str = "",
) -> DataFrame:
    """Run list filter; ``runs`` carries job_key. Runs without any time are outside every time window."""
    keep = [quick_filter(quick, F.col("status"), F.col("triggered_by"))]
    if job_key is not None:
        keep.append(F.col("job_key") == job_key)
    if status is not None:
        keep.append(display_status(F.col("status")) == status)
    if last_hours > 0:
        keep.append(run_time() >= now - F.make_dt_interval(hours=F.lit(last_hours)))
    keep.append(contains_any_case(text, F.col("run_key"), F.col("job_key"), F.col("triggered_by")))
    return runs.filter(all_of(*keep))


def in_window(rows: DataFrame, ts: Column, start: Column, end: Column) -> DataFrame:
    """Rows whose time lies between both ends, ends included."""
    return rows.filter(ts.between(start, end))


def filter_events(
    events: DataFrame,
    node_status: DataFrame | None = None,
    group: str = "all",
    step_key: str | None = None,
    level: str | None = None,
    stream: str = "all",
    text: str = "",
) -> DataFrame:
    """Event list filter. ``node_status`` is (run_id, step_key, status) of every graph node.

    With a step group, events of its steps are kept, and run-level events (empty step_key) always.
    """
    keep = [in_stream(F.col("event_type"), F.col("message"), stream)]
    if step_key is not None:
        keep.append(F.col("step_key") == step_key)
    if level is not None:
        keep.append(event_level(F.col("level")) == level)
    keep.append(
        contains_any_case(text, F.col("step_key"), F.col("event_type"), F.col("level"), F.col("message"))
    )
    kept = events.filter(all_of(*keep))
    if group == "all":
        return kept
    steps = node_status.filter(step_group(F.col("status")) == group).select("run_id", "step_key").distinct()
    run_level = kept.filter(F.col("step_key") == "")
    step_level = kept.filter(F.col("step_key") != "").join(steps, ["run_id", "step_key"], "left_semi")
    return run_level.unionByName(step_level)


def search_jobs(jobs: DataFrame, text: str) -> DataFrame:
    return jobs.filter(contains_any_case(text, F.col("display_name"), F.col("job_key"), F.col("description")))


def search_overview_jobs(jobs: DataFrame, text: str) -> DataFrame:
    """Overview search looks at label and key one by one, not at their concatenation."""
    return jobs.filter(
        contains_any_case(text, F.col("display_name")) | contains_any_case(text, F.col("job_key"))
    )


def search_queues(queues: DataFrame, queue_jobs: DataFrame, jobs: DataFrame, text: str) -> DataFrame:
    """Queues whose own text, followed by the text of their jobs in order, contains ``text``.

    A match may run across the blank between two texts only if ``text`` itself has a blank, and
    then spans at most as many job texts as it has characters; the window frame is that wide.
    """
    wanted = text.strip().lower()
    if not wanted:
        return queues
    own = queues.select(
        F.col("id").alias("queue_id"),
        F.lit(-1).cast("long").alias("place"),
        F.concat_ws(" ", "display_name", "queue_key", "description", "route_path").alias("words"),
    )
    attached = queue_jobs.join(jobs, queue_jobs.job_id == jobs.id).select(
        "queue_id", F.col("sort_index").alias("place"), F.concat_ws(" ", "display_name", "job_key").alias("words")
    )
    texts = own.unionByName(attached)
    if " " in wanted:
        reach = Window.partitionBy("queue_id").orderBy("place").rowsBetween(0, len(wanted))
        texts = texts.withColumn("words", F.concat_ws(" ", F.collect_list("words").over(reach)))
    hits = texts.filter(F.contains(F.lower("words"), F.lit(wanted))).select(F.col("queue_id").alias("id")).distinct()
    return queues.join(hits, "id", "left_semi")


def visible_graph(
    node_status: DataFrame, edges: DataFrame, hide_unexecuted: bool = False, group: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """Nodes that stay visible, and the edges whose both ends do.

    ``node_status`` is (run_id, job_id, step_key, status); ``edges`` is keyed by job_id.
    """
    kept = F.lit(True)
    if hide_unexecuted:
        kept = kept & (step_group(F.col("status")) != "not_executed")
    if group != "all":
        kept = kept & (step_group(F.col("status")) == group)
    nodes = node_status.filter(kept)
    ends = nodes.select("run_id", "job_id", "step_key")
    shown = (
        edges.join(ends.withColumnRenamed("step_key", "from_step_key"), ["job_id", "from_step_key"])
        .join(
            ends.select("run_id", F.col("step_key").alias("to_step_key")), ["run_id", "to_step_key"], "left_semi"
        )
        .select("run_id", "job_id", "from_step_key", "to_step_key")
    )
    return nodes, shown


def enabled_schedules(schedules: DataFrame, paused_jobs: DataFrame) -> DataFrame:
    """Declared enabled, and the job not paused. ``paused_jobs`` has one job_key per row."""
    return schedules.filter("is_enabled").join(paused_jobs.select("job_key").distinct(), "job_key", "left_anti")


def schedules_with_state(schedules: DataFrame, paused_jobs: DataFrame) -> DataFrame:
    """All schedules with the enabled flag the list page shows."""
    paused = paused_jobs.select("job_key").distinct().withColumn("paused", F.lit(True))
    return (
        schedules.join(paused, "job_key", "left")
        .withColumn("is_enabled", F.col("is_enabled") & ~F.coalesce("paused", F.lit(False)))
        .drop("paused")
    )
