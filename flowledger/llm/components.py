"""Connected components of a link table by contraction, in DataFrame operations.

Each round every node joins the neighbour (or itself) of the least hash for that round, links are rewritten
to the joined nodes and made distinct. Hashes that change each round make a constant share of the nodes
vanish, chains included, so the rounds grow with the logarithm of the nodes. Rounds are written to the
shared scratch folder, so a lost executor repeats a part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.session import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``links``: node, component (the least node that can be reached). Loops and repeated links are allowed."""
    ends = [F.col(a).cast("long"), F.col(b).cast("long")]
    now = materialize(links.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct(), "links")
    every = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    label = materialize(every, "link-nodes").withColumn("at", F.col("node"))
    nth, steps = 0, []
    while True:
        apart = now.filter("a <> b")
        if apart.isEmpty():
            break
        both = apart.union(apart.select("b", "a"))
        order = F.xxhash64("b", F.lit(nth))
        best = both.groupBy("a").agg(F.min_by("b", order).alias("near"), F.min(order).alias("least"))
        step = materialize(best.select(F.col("a").alias("from"), F.when(F.xxhash64("a", F.lit(nth)) < F.col("least"), F.col("a")).otherwise(F.col("near")).alias("to")), "contraction")
        to_a, to_b = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        then = materialize(apart.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        if nth:
            discard(now)
        now, nth = then, nth + 1
        steps.append(step)
    for step in steps:
        label = label.join(step.toDF("at", "next"), "at", "left").select("node", F.coalesce("next", "at").alias("at"))
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least, "at").select("node", "component")
