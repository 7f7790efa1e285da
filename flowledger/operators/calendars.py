"""Calendars of cron expressions: when each distinct (expression, zone) fires, by days.

Minutes are counted from 1970-01-01 00:00 UTC. A zone is a list of intervals between clock changes, each with
one shift from UTC to local time, so a local day becomes a UTC minute by one subtraction and no minute is ever converted by itself.
A local minute that a clock change skips lies in no interval, and one that is repeated lies in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.functions.cron import cron_spec, day_matches, local_time

DAY, HOUR = 1440, 60


def tasks(spark: SparkSession) -> int:
    """Partitions for rows that are few but grow a thousandfold later; a stated count isn't coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def minute_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 60)


def minute_time(minute: Column) -> Column:
    return F.timestamp_seconds(minute * 60)


def _shift(minute: Column, zone: Column) -> Column:
    """Minutes that the zone's clock is ahead of UTC at a UTC minute."""
    utc = minute_time(minute)
    return F.floor((F.unix_seconds(local_time(utc, zone)) - F.unix_seconds(utc)) / 60)


def zone_intervals(zones: DataFrame) -> DataFrame:
    """zone, since, until, shift: intervals of UTC minutes [since, until) with one shift; ``zones`` is (zone, first, last).

    Only hours that begin and end with different shifts are looked at by the minute. Intervals cover [first, last].
    """
    spread = zones.repartition(tasks(zones.sparkSession), "zone")
    hours = spread.select("zone", F.explode(F.sequence(F.floor(F.col("first") / HOUR), F.floor(F.col("last") / HOUR))).alias("hour"))
    start = F.col("hour") * HOUR
    changed = hours.filter(_shift(start, F.col("zone")) != _shift(start + HOUR, F.col("zone")))
    minutes = changed.select("zone", F.explode(F.sequence(start + 1, start + HOUR)).alias("since"))
    shifts = minutes.select("zone", "since", _shift(F.col("since"), F.col("zone")).alias("shift"), _shift(F.col("since") - 1, F.col("zone")).alias("before"))
    begun = spread.select("zone", F.floor(F.col("first") / HOUR).alias("hour")).select("zone", start.alias("since"))
    every = shifts.filter("shift <> before").select("zone", "since", "shift").unionByName(
        begun.select("zone", "since", _shift(F.col("since"), F.col("zone")).alias("shift"))
    )
    until = F.lead("since").over(Window.partitionBy("zone").orderBy("since"))
    return every.select("zone", "since", until.alias("until"), "shift").join(zones.select("zone", "last"), "zone").select(
        "zone", "since", F.coalesce("until", F.col("last") + 1).alias("until"), "shift"
    )


def parsed_specs(exprs: DataFrame) -> DataFrame:
    """expr, spec: the well-formed ones of the distinct expressions."""
    spread = exprs.select("expr").distinct().repartition(tasks(exprs.sparkSession), "expr")
    return spread.withColumn("spec", cron_spec(F.col("expr"))).filter("spec.valid")


def calendar(pairs: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """expr, zone, base, low, high, minutes: a row per day on which an expression can fire.

    ``pairs`` is (expr, zone, first, last), one row per distinct expression and zone. The ticks of a row are
    base + m for each m of ``minutes``, of those in [low, high]. Malformed expressions have none. ``specs`` are
    the parsed expressions, where a caller has them already.
    """
    parsed = pairs.filter("first <= last").join(parsed_specs(pairs) if specs is None else specs, "expr")
    zones = pairs.filter("first <= last").groupBy("zone").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    placed = parsed.join(zone_intervals(zones), "zone").select(
        "expr", "zone", "spec", "shift", F.greatest("first", "since").alias("low"), F.least("last", F.col("until") - 1).alias("high")
    ).filter("low <= high")
    local = [F.floor((F.col(c) + F.col("shift")) / DAY).cast("int") for c in ("low", "high")]
    days = F.filter(F.sequence(*local), lambda d: day_matches(F.col("spec"), F.date_from_unix_date(d)))
    minutes = F.flatten(F.transform("spec.hour", lambda h: F.transform(F.col("spec.minute"), lambda m: (h * HOUR + m).cast("short"))))
    return placed.select("expr", "zone", "shift", "low", "high", minutes.alias("minutes"), F.explode(days).alias("day")).select(
        "expr", "zone", (F.col("day") * F.lit(DAY).cast("long") - F.col("shift")).alias("base"), "low", "high", "minutes"
    )
