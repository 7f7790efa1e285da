"""Several tables written per micro-batch, safe to repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from flowledger.operators.latest import top_per_group


class BatchSink:
    """Tables under one folder, each with one sub-folder per micro-batch.

    A repeated batch overwrites its own sub-folders. A batch counts only once its commit row is
    written, after all its tables, so readers see all tables of a batch or none.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def put(self, batch_id: int, name: str, rows: DataFrame) -> DataFrame:
        """Write one table of a batch without committing it, and read it back."""
        path = f"{self.folder}/{name}/batch={batch_id}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)  # hashed keys take half the bytes
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def write(self, batch_id: int, **tables: DataFrame) -> None:
        """Write tables of a batch and commit it."""
        for name, rows in tables.items():
            self.put(batch_id, name, rows)
        spark = next(iter(tables.values())).sparkSession
        spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch_id}")

    def read(self, spark: SparkSession, name: str, schema: StructType) -> DataFrame:
        """All committed rows of a table, with their batch."""
        full = StructType(list(schema.fields)).add("batch", LongType())
        try:
            rows = spark.read.schema(full).parquet(f"{self.folder}/{name}")
            commits = spark.read.schema("id long, batch long").parquet(f"{self.folder}/commits").select("batch")
        except AnalysisException:
            return spark.createDataFrame([], full)
        return rows.join(commits, "batch", "left_semi")

    def latest(
        self, spark: SparkSession, name: str, schema: StructType, *keys: str, before: int | None = None
    ) -> DataFrame:
        """Newest committed row per key, for tables written by update-mode streams.

        ``before`` looks only at earlier batches, so a repeated batch sees what it saw the first time.
        """
        rows = self.read(spark, name, schema)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return top_per_group(rows, keys, [F.col("batch").desc()], 1).drop("rank", "batch")


def run_stream(
    rows: DataFrame,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None],
    poll_every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a stream into ``on_batch``.

    Without ``poll_every`` the query drains what is there and ends; with it (``"60 seconds"``) it looks
    again at that interval, once at the start.
    """
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    writer = writer.trigger(processingTime=poll_every) if poll_every else writer.trigger(availableNow=True)
    return writer.start()


def table_stream(
    spark: SparkSession, schema: StructType, path: str, files: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream over a folder of parquet files; ``files`` picks them by name pattern."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def load_stream(mode: str, rows: DataFrame, checkpoint: str, on_batch, poll_seconds: int = 0) -> StreamingQuery:
    """Start a queue's loader by its load mode: ``poll`` looks at intervals, ``stream`` runs on without pause."""
    if mode == "poll":
        return run_stream(rows, checkpoint, on_batch, f"{poll_seconds} seconds" if poll_seconds else None)
    return run_stream(rows, checkpoint, on_batch, "0 seconds")
