"""The run list page: filter, sort and page in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.times import duration_ms
from flowledger.operators.filters import filter_runs, run_time
from flowledger.operators.ordering import run_order

PAGE_ROWS = 50


def run_page(runs: DataFrame, now: Column, sort: str = "newest", page_index: int = 0, **filter_options) -> DataFrame:
    """One page of the filtered run list. Spark keeps only the top rows of each partition."""
    kept = filter_runs(runs, now, **filter_options)
    shown = kept.withColumns(
        {"ts": run_time(), "duration_ms": duration_ms(F.col("started_at"), F.col("completed_at"))}
    )
    return shown.orderBy(*run_order(sort)).offset(page_index * PAGE_ROWS).limit(PAGE_ROWS)
