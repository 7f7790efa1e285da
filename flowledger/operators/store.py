"""Writing history: append, insert with defaults, upsert, insert-if-absent, replace, cascade delete.

Files are never changed in place. Each function gives the new snapshot or the rows to append; callers
write them to a new folder, and a lost executor only repeats a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.params import merge_payload, payload_json
from flowledger.functions.text import non_empty
from flowledger.operators.joins import fan_out_steps
from flowledger.operators.latest import top_per_group


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def new_event(
    run: Column, step_key: Column, event_type: str, level: str, message: Column, payload: Column | None = None
) -> list[Column]:
    """Columns of one event log row. Without a payload the data is ``{}``."""
    data = F.lit("{}") if payload is None else payload_json(payload)
    return [
        run,
        step_key.alias("step_key"),
        F.lit(event_type).alias("event_type"),
        F.lit(level).alias("level"),
        message.alias("message"),
        data.alias("event_data_json"),
    ]


def stable_key(prefix: str, *parts: Column) -> Column:
    """Key that is the same on every retry, so a replayed write can be recognised."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u0000", *parts), 256))


@dataclass
class QueuedRuns:
    runs: DataFrame
    steps: DataFrame
    events: DataFrame
    rejected: DataFrame


def insert_queued_runs(requests: DataFrame, nodes: DataFrame, now: Column) -> QueuedRuns:
    """Queued runs with one pending step per node and one ``run_queued`` event each.

    ``requests`` is (run_key, job_id, triggered_by, params_json, queued_at, parent_run_id,
    rerun_step_key, error_message, event_payload map). Requests for a job without nodes are rejected.
    Children refer to their run by run_key, which is known before any id is given out.
    """
    jobs_with_nodes = nodes.select("job_id").distinct()
    accepted = requests.join(jobs_with_nodes, "job_id", "left_semi")
    rejected = requests.join(jobs_with_nodes, "job_id", "left_anti").withColumn("error", F.lit("job has no nodes"))
    runs = accepted.select(
        "run_key",
        "job_id",
        F.lit("queued").alias("status"),
        non_empty(F.col("triggered_by"), F.lit("manual")).alias("triggered_by"),
        non_empty(F.col("params_json"), F.lit("{}")).alias("params_json"),
        F.coalesce("queued_at", now).alias("queued_at"),
        F.coalesce("parent_run_id", F.lit(0)).cast("long").alias("parent_run_id"),
        F.coalesce("rerun_step_key", F.lit("")).alias("rerun_step_key"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        "event_payload",
    )
    steps = fan_out_steps(runs.withColumnRenamed("run_key", "run_id"), nodes).withColumnRenamed("run_id", "run_key")
    origin = F.create_map(
        F.lit("triggered_by"),
        F.col("triggered_by"),
        F.lit("parent_run_id"),
        F.col("parent_run_id").cast("string"),
        F.lit("rerun_step_key"),
        F.col("rerun_step_key"),
    )
    extra = F.coalesce("event_payload", F.create_map().cast("map<string,string>"))
    events = runs.select(
        *new_event(F.col("run_key"), F.lit(""), "run_queued", "info", F.lit("run queued"), merge_payload(origin, extra))
    )
    return QueuedRuns(runs.drop("event_payload"), steps, events, rejected)


def upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[Column], keep: Sequence[str] = ()
) -> DataFrame:
    """New snapshot of ``base`` after keyed updates; of several updates the highest version wins.

    Columns in ``keep`` (surrogate id, created_at) hold their base value once a row exists.
    """
    newest = [v.desc() for v in version]
    columns = base.columns
    winner = top_per_group(updates, keys, newest, 1).select(*columns)
    old = base.select(F.struct(*columns).alias("old"), *keys)
    new = winner.select(F.struct(*columns).alias("new"), *keys)
    both = old.join(new, list(keys), "full_outer")

    def pick(column: str) -> Column:
        before, after = F.col("old")[column], F.col("new")[column]
        if column in keep:
            return F.when(F.col("old").isNotNull(), before).otherwise(after)
        return F.when(F.col("new").isNotNull(), after).otherwise(before)

    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in columns])


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows that win: first per key among ``rows`` by ``order``, and no such key in ``base``.

    The order decides which row a retry keeps, so it has to be given.
    """
    first = top_per_group(rows, keys, list(order), 1).drop("rank")
    return first.join(base.select(*keys), list(keys), "left_anti")


def replace_children(base: DataFrame, parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """New snapshot in which every parent in ``parents`` has exactly the given children.

    Children of parents that are not in the input stay as they are.
    """
    kept = base.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.unionByName(children)


def delete_cascade(
    parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]
) -> dict[str, DataFrame]:
    """Snapshots of a parent table and its children without the deleted parents.

    ``children`` maps a name to (rows, column that refers to the parent).
    """
    ids = gone.select(F.col(key))
    left = {"parent": parents.join(ids, key, "left_anti")}
    for name, (rows, column) in children.items():
        left[name] = rows.join(ids.withColumnRenamed(key, column), column, "left_anti")
    return left


def first_definitions(listed: DataFrame, through_queues: DataFrame) -> DataFrame:
    """Job definitions listed directly and through queues; the first in listing order wins.

    Both inputs are (job_key, listed_at, display_name, ...), ``listed_at`` being the place in the call.
    """
    every = listed.unionByName(through_queues)
    return top_per_group(every, ["job_key"], [F.col("listed_at").asc()], 1).drop("rank")


def not_in_registry(stored: DataFrame, registry: DataFrame, key: str = "job_key") -> DataFrame:
    """Stored rows that the current registry no longer declares. They are kept, only reported."""
    return stored.join(registry.select(key), key, "left_anti")


def sync_catalogue(stored: DataFrame, declared: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Stored rows after a registry sync: declared ones updated or added, the others untouched."""
    return upsert(stored, declared, [key], [F.col(key)], keep)
