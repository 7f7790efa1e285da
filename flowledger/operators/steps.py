"""User functions: typed steps, partition keys, metadata, and captured failures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowledger.functions.params import partition_key


class ContractError(ValueError):
    """A step's input or output does not have the declared columns."""


def _check(df: DataFrame, wanted: StructType, step: str, side: str) -> DataFrame:
    have = {f.name: f.dataType for f in df.schema}
    for field in wanted:
        if field.name not in have:
            raise ContractError(f"step {step}: {side} lacks column {field.name}")
        if have[field.name] != field.dataType:
            raise ContractError(
                f"step {step}: {side} column {field.name} is {have[field.name].simpleString()}, "
                f"not {field.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in wanted])


def typed_step(
    step: str, takes: StructType, gives: StructType, fn: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame step with a checked contract, for use with ``df.transform``.

    Schemas are compared when the plan is built; no row is touched.
    """

    def run(df: DataFrame) -> DataFrame:
        return _check(fn(_check(df, takes, step, "input")), gives, step, "output")

    return run


def split_by_partition_key(rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable partition key, and rejected rows with the reason.

    ``key`` is any Column: an expression or a ``pandas_udf`` applied to columns.
    """
    keyed = rows.withColumn("partition_key", partition_key(key))
    good = keyed.filter("partition_key is not null")
    bad = keyed.filter("partition_key is null").drop("partition_key").withColumn(
        "error", F.lit("partition key is required")
    )
    return good, bad


def publish_metadata(rows: DataFrame, metadata: Column) -> DataFrame:
    """Metadata JSON of each successful row; empty maps publish nothing."""
    return rows.withColumn("metadata_json", F.to_json(metadata)).filter(F.size(metadata) > 0)


def capture_failures(rows: DataFrame, step: str, fn: Callable[[dict], dict]) -> DataFrame:
    """Apply ``fn`` to each row; a failing row gives its message and the others go on.

    Adds status, error_message and output_json. Rows stream through in Arrow batches, whose values keep
    their types: a whole number stays one where others of its column are absent.
    """
    added = ("status", "error_message", "output_json")
    schema = StructType([*rows.schema.fields])
    for name in added:
        schema = schema.add(name, "string")

    def one(record: dict) -> tuple[str, str, str]:
        try:
            return "success", "", json.dumps(fn(record), sort_keys=True, separators=(",", ":"))
        except Exception as error:
            return "failed", f"panic in step {step}: {error}", "{}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(record) for record in batch.to_pylist()]
            texts = [pa.array([d[i] for d in done], pa.string()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *texts], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, schema)
