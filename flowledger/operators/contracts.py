"""Typed step contracts: which steps provide each input field, and what a run feeds into them.

``outputs`` is (job_id, step_key, type_name): the output type of each step. ``fields`` is (job_id,
step_key, field_pos, field_name, field_type): the typed input fields, where ``[]T`` takes any number of
providers, ``*T`` none or one, and ``T`` exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MISFIT = "_misfit"
FIELD = ["job_id", "step_key", "field_pos", "field_name"]
# Type names that are no structs.
PLAIN_TYPES = (
    "any", "bool", "byte", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32",
    "int64", "rune", "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr",
)


def field_modes(fields: DataFrame) -> DataFrame:
    """Adds mode (singular, pointer, slice), target_type and error, '' for a usable field."""
    shape = F.regexp_extract("field_type", r"^(\[\]|\*)?(.*)$", 1)
    target = F.regexp_extract("field_type", r"^(\[\]|\*)?(.*)$", 2)
    mode = F.when(shape == "[]", F.lit("slice")).when(shape == "*", F.lit("pointer")).otherwise(F.lit("singular"))
    is_struct = ~target.isin(*PLAIN_TYPES) & ~target.rlike(r"^(\[|\*|map\[|func\(|chan |interface ?\{|$)")
    wanted = F.concat(shape, F.lit("T"))
    error = F.when(is_struct, F.lit("")).otherwise(
        F.concat(
            F.lit("unsupported "), mode, F.lit(" input type "), F.col("field_type"), F.lit(": expected "), wanted,
            F.lit(" where T is a struct"),
        )
    )
    return fields.withColumns({"mode": mode, "target_type": target, "error": error})


def provider_counts(fields: DataFrame, outputs: DataFrame) -> DataFrame:
    """Candidates per field, itself excluded, with the provider where there is exactly one.

    Works on one row per (job, type), so a type with many providers is not paired with every field.
    """
    typed = field_modes(fields).filter("error = ''")
    per_type = outputs.groupBy("job_id", F.col("type_name").alias("target_type")).agg(
        F.count(F.lit(1)).alias("makers"), F.min("step_key").alias("lowest"), F.max("step_key").alias("highest")
    )
    own = outputs.select("job_id", "step_key", F.col("type_name").alias("target_type"), F.lit(1).alias("own"))
    counted = (
        typed.join(per_type, ["job_id", "target_type"], "left")
        .join(own, ["job_id", "step_key", "target_type"], "left")
        .withColumn("candidates", F.coalesce("makers", F.lit(0)) - F.coalesce("own", F.lit(0)))
    )
    other = F.when(F.col("own").isNotNull() & (F.col("lowest") == F.col("step_key")), F.col("highest")).otherwise(
        F.col("lowest")
    )
    return counted.withColumn("provider", F.when(F.col("candidates") == 1, other)).drop(
        "makers", "lowest", "highest", "own", "error"
    )


def providers(fields: DataFrame, outputs: DataFrame) -> DataFrame:
    """Bindings, one row per (field, provider): the single one, or all of a slice field."""
    counted = provider_counts(fields, outputs)
    columns = [*FIELD, "mode", "target_type", "provider"]
    single = counted.filter("mode <> 'slice' and provider is not null").select(*columns)
    makers = outputs.select("job_id", F.col("type_name").alias("target_type"), F.col("step_key").alias("maker"))
    several = (
        counted.filter("mode = 'slice' and candidates > 0")
        .drop("provider")
        .join(makers, ["job_id", "target_type"])
        .filter("maker <> step_key")
        .withColumnRenamed("maker", "provider")
        .select(*columns)
    )
    return single.unionByName(several)


def contract_errors(fields: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fields whose providers break the rule of their mode, and fields of an unsupported type.

    Messages give the number of candidates; ``ambiguous_candidates`` names them, a row each. Their texts are
    fixed values.
    """
    counted = provider_counts(fields, outputs)
    missing = counted.filter("mode = 'singular' and candidates = 0").select(
        *FIELD,
        F.concat(
            F.lit("input field "), "field_name", F.lit(" ("), "target_type", F.lit(") requires exactly 1 provider, found 0")
        ).alias("message"),
    )
    rule = F.when(F.col("mode") == "pointer", F.lit("pointer input allows 0 or 1 provider")).otherwise(
        F.lit("expected exactly 1 provider")
    )
    too_many = counted.filter("mode <> 'slice' and candidates > 1").select(
        *FIELD,
        F.concat(
            F.lit("input field "), "field_name", F.lit(" ("), "target_type", F.lit(") is ambiguous: "), rule,
            F.lit(", found "), F.col("candidates").cast("string"),
        ).alias("message"),
    )
    unsupported = field_modes(fields).filter("error <> ''").select(
        *FIELD, F.concat(F.lit("input field "), "field_name", F.lit(": "), "error").alias("message")
    )
    return missing.unionByName(too_many).unionByName(unsupported)


def ambiguous_candidates(fields: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every candidate of every ambiguous field, one row each, however many there are."""
    makers = outputs.select("job_id", F.col("type_name").alias("target_type"), F.col("step_key").alias("candidate"))
    ambiguous = provider_counts(fields, outputs).filter("mode <> 'slice' and candidates > 1")
    return ambiguous.join(makers, ["job_id", "target_type"]).filter("candidate <> step_key").select(*FIELD, "candidate")


def ordered_providers(bindings: DataFrame, order: DataFrame) -> DataFrame:
    """Bindings with the topological index of the provider, by which slice inputs are read."""
    index = order.select("job_id", F.col("step_key").alias("provider"), F.col("topo_index").alias("provider_index"))
    return bindings.join(index, ["job_id", "provider"])


def step_inputs(
    runs: DataFrame, ordered: DataFrame, outputs: DataFrame, schema: StructType, step_key: Column | None = None
) -> DataFrame:
    """Decoded input values of every step of every run, one row per (field, provider).

    ``outputs`` is (run_id, step_key, output_json) of the steps that succeeded. ``error`` names a
    missing or undecodable output; ``value`` is the provider's output as ``schema``.
    """
    made = outputs.select("run_id", F.col("step_key").alias("provider"), "output_json")
    wanted = runs.select("run_id", "job_id").join(ordered, "job_id")
    text = F.col("output_json")
    # An output whose values don't fit the schema fills the extra column; ``null`` is an empty struct.
    whole = StructType([*schema.fields, StructField(MISFIT, StringType())])
    is_null = F.trim(text) == "null"
    decoded = F.from_json(F.when(is_null, F.lit("{}")).otherwise(text), whole, {"columnNameOfCorruptRecord": MISFIT})
    parsed = F.struct(*[decoded[f.name].alias(f.name) for f in schema.fields])
    shape = F.schema_of_variant(F.try_parse_json(text))
    is_object = is_null | (F.startswith(F.coalesce(shape, F.lit("")), F.lit("OBJECT")) & decoded[MISFIT].isNull())
    kind = F.when(F.col("mode") == "singular", F.lit("")).otherwise(F.concat("mode", F.lit(" ")))
    error = (
        F.when(
            text.isNull(),
            F.concat(F.lit("missing output from dependency "), "provider", F.lit(" for "),
                     F.when(F.col("mode") == "slice", F.lit("slice ")).otherwise(F.lit("")), F.lit("field "), "field_name"),
        )
        .when(~is_object, F.concat(F.lit("decode dependency "), "provider", F.lit(" into "), kind, F.lit("field "), "field_name"))
        .otherwise(F.lit(""))
    )
    return wanted.join(made, ["run_id", "provider"], "left").select(
        "run_id", *FIELD, "mode", "provider", "provider_index", F.when(error == "", parsed).alias("value"), error.alias("error")
    )


def input_errors(inputs: DataFrame) -> DataFrame:
    """First input error of each step, in field and provider order; such steps fail before they start."""
    broken = inputs.filter("error <> ''")
    return broken.groupBy("run_id", "step_key").agg(
        F.min_by("error", F.struct("field_pos", "provider_index")).alias("error")
    )
