"""Row numbers that stay spread out when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.session import materialize


def _bucketed(rows: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn("_bucket", F.spark_partition_id()), "rank-buckets")


def _before(bucketed: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Per group and bucket, ``_shift``: the total of the group's earlier buckets."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.groupBy(*keys, "_bucket")
        .agg(total.alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """One-based place of each row in its group. ``order`` must be unique within the group.

    Rows are range-partitioned by (group, order), so a large group spans many buckets. Each bucket is numbered
    on its own and shifted by the rows of the buckets before it; no task sees a whole large group.
    """
    keys = list(keys)
    bucketed = _bucketed(rows, keys, order)
    shift = _before(bucketed, keys, F.count(F.lit(1)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        bucketed.withColumn("_place", inside)
        .join(shift, [*keys, "_bucket"])
        .withColumn(name, (F.col("_shift") + F.col("_place")).cast("long"))
        .select(*rows.columns, name)
    )


def total_before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row, spread out as in :func:`rank_within`."""
    keys = list(keys)
    bucketed = _bucketed(rows, keys, order)
    shift = _before(bucketed, keys, F.sum(value))
    earlier = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("_inside", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        .join(shift, [*keys, "_bucket"])
        .withColumn(name, F.col("_shift") + F.col("_inside"))
        .select(*rows.columns, name)
    )
