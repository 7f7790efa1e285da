"""Run parameters, event payloads and log attributes as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, TimestampNTZType, TimestampType

from flowledger.functions.text import clean

# Key the queue block is stored under in run parameters. Pass another where a history uses one.
QUEUE_KEY = "workflow_queue"


def rfc3339(ts: Column) -> Column:
    """UTC text with as many fraction digits as needed, none when whole."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def queue_params(
    queue_key: Column, item_id: Column, partition_key: Column, external_key: Column, payload_json: Column, key: str = QUEUE_KEY
) -> Column:
    """Parameters of a run started for a queue item; keys in alphabetical order."""
    block = F.struct(
        clean(external_key).alias("external_key"),
        clean(partition_key).alias("partition_key"),
        F.try_parse_json(payload_json).alias("payload"),
        item_id.alias("queue_item_id"),
        clean(queue_key).alias("queue_key"),
    )
    return F.to_json(F.struct(block.alias(key)))


def scheduled_params(scheduled_for: Column, schedule_key: Column, scheduler_key: Column) -> Column:
    return F.to_json(
        F.struct(
            schedule_key.alias("schedule_key"),
            rfc3339(scheduled_for).alias("scheduled_for"),
            scheduler_key.alias("scheduler_key"),
        )
    )


def note_params(note: Column) -> Column:
    """Parameters of a manual run: its note, if there is one."""
    text = clean(F.coalesce(note, F.lit("")))
    return F.when(text == "", F.lit("{}")).otherwise(F.to_json(F.struct(text.alias("note"))))


def merge_payload(base: Column, extra: Column) -> Column:
    """Two maps in one; where both have a key, ``extra`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def payload_json(payload: Column) -> Column:
    """Map to JSON with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(block: Column, name: str) -> Column:
    value = F.try_variant_get(block, f"$.{name}", "variant")
    return F.when(_kind(value) == "STRING", clean(F.try_variant_get(block, f"$.{name}", "string"))).otherwise(F.lit(""))


def _whole(block: Column, name: str) -> Column:
    """A JSON number cut to a whole number; anything else is 0."""
    path = f"$.{name}"
    kind = _kind(F.try_variant_get(block, path, "variant"))
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.coalesce(F.when(is_number, F.try_variant_get(block, path, "bigint")), F.lit(0).cast("long"))


def queue_meta(params_json: Column, key: str = QUEUE_KEY) -> Column:
    """Queue block of stored run parameters.

    A struct (queue_key, queue_item_id, partition_key, external_key, payload_json, error), or NULL
    where the parameters have no such block. ``error`` is '' for a usable block.
    """
    params = F.try_parse_json(params_json)
    path = f"$['{key}']"
    block = F.try_variant_get(params, path, "variant")
    is_object = F.startswith(_kind(block), F.lit("OBJECT"))
    whole = _whole(block, "queue_item_id")
    error = (
        F.when(~is_object, F.lit("queue params payload is invalid"))
        .when(
            (_text(block, "queue_key") == "") | (whole <= 0) | (_text(block, "partition_key") == ""),
            F.lit("queue params are incomplete"),
        )
        .otherwise(F.lit(""))
    )
    return F.when(
        block.isNotNull(),
        F.struct(
            _text(block, "queue_key").alias("queue_key"),
            whole.alias("queue_item_id"),
            _text(block, "partition_key").alias("partition_key"),
            _text(block, "external_key").alias("external_key"),
            F.to_json(F.try_variant_get(block, "$.payload", "variant")).alias("payload_json"),
            error.alias("error"),
        ),
    )


def payload_struct(payload: Column, schema: StructType) -> Column:
    """Payload JSON read back as a struct; NULL where it does not parse."""
    return F.from_json(payload, schema, {"mode": "PERMISSIVE"})


def partition_key(value: Column) -> Column:
    """Trimmed partition key, NULL where nothing is left; such rows are rejected."""
    return F.nullif(clean(value), F.lit(""))


def scheduler_trigger(schedule_key: Column) -> Column:
    return F.concat(F.lit("scheduler:"), schedule_key)


def queue_trigger(queue_key: Column) -> Column:
    return F.concat(F.lit("queue:"), queue_key)


def trigger_origin(triggered_by: Column) -> Column:
    """(origin, key) of a trigger label: ``scheduler:hourly`` is ('scheduler', 'hourly')."""
    parts = F.split(triggered_by, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("origin"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("key"))


def dotted_key(groups: Column, key: Column) -> Column:
    return F.array_join(F.concat(groups, F.array(key)), ".")


def flat_attributes(value: Column, dtype: DataType, path: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """Leaves of a struct as (dotted key, text); times as RFC 3339, blank names dropped.

    Walks the schema on the driver; the values are plain column expressions.
    """
    if isinstance(dtype, StructType):
        leaves = []
        for field in dtype.fields:
            if field.name.strip():
                leaves += flat_attributes(value.getField(field.name), field.dataType, (*path, field.name))
        return leaves
    text = rfc3339(value) if isinstance(dtype, (TimestampType, TimestampNTZType)) else value.cast("string")
    return [(".".join(path), text)]


def attribute_map(value: Column, dtype: StructType) -> Column:
    pairs = []
    for key, text in flat_attributes(value, dtype):
        pairs += [F.lit(key), text]
    return F.create_map(*pairs)
