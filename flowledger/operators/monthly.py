"""History stored by month of completion, so that a purge rewrites only the months it touches.

A run lies in the month in which it completed, ``open`` before that, and what hangs on a run lies in the run's month.
Removing rows finds the months that hold them, rewrites those by a dynamic partition overwrite, and drops the ones
that are empty then; files of all other months stay as they are. The overwrite stages all kept rows before it replaces the first
month, so a lost executor repeats its tasks from files that are still there, and a purge that broke off can be repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowledger.functions.times import retention_cutoff
from flowledger.operators.filters import purgeable
from flowledger.operators.joins import without_links
from flowledger.session import materialize

OPEN = "open"  # sorts after all months


def month_of(completed_at: Column) -> Column:
    return F.coalesce(F.date_format(completed_at, "yyyy-MM"), F.lit(OPEN))


class MonthlyTable:
    """Rows under one folder, partitioned by ``month``."""

    def __init__(self, path: str, schema: StructType):
        self.path = path.rstrip("/")
        self.schema = StructType([*[f for f in schema.fields if f.name != "month"], StructField("month", StringType())])

    def append(self, rows: DataFrame) -> None:
        """Add rows that carry their month; equal months are written together."""
        rows.repartition("month", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("append").partitionBy("month").parquet(self.path)

    def read(self, spark: SparkSession, months: Sequence[str] | None = None) -> DataFrame:
        rows = spark.read.schema(self.schema).parquet(self.path)
        return rows if months is None else rows.filter(F.col("month").isin(*months) if months else F.lit(False))

    def remove(self, ids: DataFrame, column: str, last: str | None = None) -> None:
        """Remove the rows whose ``column`` is in the stored ``ids``, of those up to month ``last``."""
        spark = ids.sparkSession
        listed = ids.select(F.col(ids.columns[0]).alias(column))
        rows = self.read(spark) if last is None else self.read(spark).filter(F.col("month") <= last)
        # Months of a history are few, whatever its rows.
        gone = {r.month: r["count"] for r in rows.join(listed, column, "left_semi").groupBy("month").count().collect()}
        if not gone:
            return
        every = {r.month: r["count"] for r in self.read(spark, list(gone)).groupBy("month").count().collect()}
        left = [month for month, n in gone.items() if n < every[month]]
        if left:
            kept = self.read(spark, left).join(listed, column, "left_anti").select(*self.schema.names)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path)
        for month in set(gone) - set(left):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/month={month}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def purge_months(spark: SparkSession, tables: dict[str, MonthlyTable], now: Column, days: int) -> None:
    """Purge the six tables as :func:`retention_split` splits them, month by month.

    What hangs on runs and items goes first and the runs last, so a repeated purge finds what is left to do. Zero or
    fewer days purge nothing.
    """
    if days <= 0:
        return
    cutoff = retention_cutoff(now, days)
    last = spark.range(1).select(month_of(cutoff)).first()[0]
    runs = tables["runs"].read(spark).filter(F.col("month") <= last)
    gone_runs = materialize(runs.filter(purgeable(F.col("completed_at"), F.col("status"), cutoff)).select(F.col("id").alias("run_id")), "gone-runs")
    items = tables["queue_items"].read(spark).filter(F.col("month") <= last)
    links_left = tables["queue_item_runs"].read(spark).select("run_id", "queue_item_id").join(gone_runs, "run_id", "left_anti")
    gone_items = materialize(without_links(items.filter(F.col("completed_at") < cutoff), links_left).select("id"), "gone-items")
    for name in ("run_steps", "run_events", "queue_item_step_metadata", "queue_item_runs"):
        tables[name].remove(gone_runs, "run_id", last)
    for name in ("queue_item_step_metadata", "queue_item_runs"):
        tables[name].remove(gone_items, "queue_item_id", last)
    tables["queue_items"].remove(gone_items, "id", last)
    tables["runs"].remove(gone_runs, "id", last)
