"""Sort orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.text import label
from flowledger.functions.times import duration_ms
from flowledger.operators.filters import run_time


def by_freshness(runs: DataFrame) -> DataFrame:
    return runs.orderBy(*run_order("newest"))


def run_order(mode: str) -> list[Column]:
    """Sort columns of a run list: newest, oldest or duration_desc."""
    if mode == "oldest":
        return [run_time().asc_nulls_first(), F.col("id").asc()]
    if mode == "duration_desc":
        length = duration_ms(F.col("started_at"), F.col("completed_at"))
        return [length.desc(), run_time().desc_nulls_last(), F.col("id").desc()]
    return [run_time().desc_nulls_last(), F.col("id").desc()]


def by_label(rows: DataFrame, key: str) -> DataFrame:
    """Order by display name as people read it, then by key."""
    shown = label(F.col("display_name"), F.col(key))
    return rows.orderBy(F.collate(shown, "UNICODE"), F.col(key))
