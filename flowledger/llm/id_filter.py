"""Take the rows of listed ids out of a wide table without moving the other rows.

A bit set of fixed size over the hashed ids, read as a scalar subquery, tells which rows can't be listed;
only the rest take part in the exact join. When the ids are many the bit set fills up and the join does
the work, so the result is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the bit set.
WORDS = 1 << 15


def _place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(WORDS * 64))
    return F.floor(at / 64).cast("int"), at


def _bits(ids: DataFrame, key: str) -> DataFrame:
    """One row with the bit set; every word is there, so it can be indexed."""
    word, at = _place(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = ids.select(word.cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = ids.sparkSession.range(WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    packed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(packed, lambda x: x["bits"]).alias("bitmap"))


def maybe_listed(ids: DataFrame, key: str) -> Column:
    """False for a row whose ``key`` isn't in ``ids``; true for all that are and few others. Store ``ids`` first."""
    word, at = _place(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    return F.get(_bits(ids, key).scalar(), word).bitwiseAND(bit) != 0


def _like(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The ids in the type of the rows' key, which hashes depend on."""
    return ids.select(F.col(key).cast(rows.schema[key].dataType).alias(key))


def listed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in the stored table ``ids``."""
    ids = _like(ids, rows, key)
    return rows.filter(maybe_listed(ids, key)).join(ids, key, "left_semi")


def unlisted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` isn't in the stored table ``ids``; a null key never is."""
    ids = _like(ids, rows, key)
    maybe = maybe_listed(ids, key)
    return rows.filter(~maybe).unionByName(rows.filter(maybe).join(ids, key, "left_anti"))
