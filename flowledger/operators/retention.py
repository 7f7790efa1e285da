"""Retention: which rows of the six history tables are purged, and which are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.times import retention_cutoff
from flowledger.operators.filters import purgeable
from flowledger.operators.joins import without_links

BATCH = 1000


def purge_batch(runs: DataFrame, cutoff: Column, limit: int = BATCH) -> DataFrame:
    """The oldest finished runs, for callers that purge in batches."""
    due = runs.filter(purgeable(F.col("completed_at"), F.col("status"), cutoff))
    return due.orderBy("completed_at", "id").limit(limit)


@dataclass
class Split:
    """Kept and purged rows of one table."""

    kept: DataFrame
    purged: DataFrame


def _split(rows: DataFrame, gone: DataFrame, *keys: str) -> Split:
    on = list(keys)
    return Split(rows.join(gone, on, "left_anti"), rows.join(gone, on, "left_semi"))


def retention_split(
    runs: DataFrame,
    steps: DataFrame,
    events: DataFrame,
    items: DataFrame,
    links: DataFrame,
    metadata: DataFrame,
    now: Column,
    days: int,
) -> dict[str, Split]:
    """Split runs by age, then items that have no run left, with everything that hangs on either.

    One set-based pass: purging items never frees another run, so nothing has to be repeated. Zero
    or fewer days purge nothing.
    """
    cutoff = retention_cutoff(now, days) if days > 0 else F.lit(None).cast("timestamp")
    old_run = F.coalesce(purgeable(F.col("completed_at"), F.col("status"), cutoff), F.lit(False))
    run_split = Split(runs.filter(~old_run), runs.filter(old_run))
    gone_runs = run_split.purged.select(F.col("id").alias("run_id"))

    links_left = links.join(gone_runs, "run_id", "left_anti")
    old_item = F.coalesce(F.col("completed_at") < cutoff, F.lit(False))
    gone_items = without_links(items.filter(old_item), links_left).select("id")
    item_split = _split(items, gone_items, "id")
    gone_item_ids = gone_items.withColumnRenamed("id", "queue_item_id")

    def by_run_or_item(rows: DataFrame) -> Split:
        by_run = _split(rows, gone_runs, "run_id")
        by_item = _split(by_run.kept, gone_item_ids, "queue_item_id")
        return Split(by_item.kept, by_run.purged.unionByName(by_item.purged))

    return {
        "runs": run_split,
        "run_steps": _split(steps, gone_runs, "run_id"),
        "run_events": _split(events, gone_runs, "run_id"),
        "queue_items": item_split,
        "queue_item_runs": by_run_or_item(links),
        "queue_item_step_metadata": by_run_or_item(metadata),
    }


def retention_counts(split: dict[str, Split], tables: tuple[str, ...] = ("runs", "queue_items")) -> DataFrame:
    """Purged and kept rows per table."""
    parts = []
    for table in tables:
        for side, rows in (("purged", split[table].purged), ("kept", split[table].kept)):
            parts.append(
                rows.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(table).alias("table_name"), F.lit(side).alias("side"), "rows"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
