"""Scans of history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from flowledger.functions.times import stored_time
from flowledger.sources.schemas import TABLES


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Parquet scan of one history table with its fixed schema."""
    return spark.read.schema(TABLES[table]).parquet(path)


def read_exported_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan of a table exported with times as text, where '' means absent.

    Text times become timestamps and absent ones NULL; all other columns keep their type.
    """
    stored = StructType(
        [StructField(f.name, StringType()) if isinstance(f.dataType, TimestampType) else f for f in TABLES[table]]
    )
    return typed_times(spark.read.schema(stored).parquet(path), table)


def typed_times(rows: DataFrame, table: str) -> DataFrame:
    """Turn the time columns of ``rows`` that are still text into timestamps."""
    is_time = {f.name for f in TABLES[table] if isinstance(f.dataType, TimestampType)}
    is_text = {f.name for f in rows.schema if isinstance(f.dataType, StringType)}
    return rows.select(
        *[stored_time(F.col(c)).alias(c) if c in is_time and c in is_text else F.col(c) for c in rows.columns]
    )
