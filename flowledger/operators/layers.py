"""Depths and cycles of dependency graphs by joins: no task holds a graph, and there is no Python.

A step with one dependency takes its depth from it, so such steps are first attached to the nearest step above
that has none or several, by pointers that double their reach: chains and trees of any length cost a logarithm of rounds.
What is left is peeled: a step is free once all its dependencies are, and each round handles only the edges of the
steps that the round before set free. There are as many rounds as the longest path has steps with several
dependencies. Every round is written to the shared scratch folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.operators.ranking import rank_within
from flowledger.session import discard, materialize, scratch_path

NODE = ["job_id", "step_key"]


def follow(pointers: DataFrame, key: str) -> DataFrame:
    """Each row's pointer followed to the end: (key, step_key, up, last, steps, open).

    ``pointers`` is (key, step_key, up, last), one row per step; ``up`` ends at a step without a pointer of its own, ``steps``
    pointers away, and ``last`` is that of the last row on the way. ``open`` rows lie on a cycle or point into
    one. Store ``pointers`` first. Stored keys take far less than they do in memory, and both sides of a round are alike, so
    they meet by a merge: no round sends a side through the driver. The nth round ends the rows that are 2^n to 2^(n+1) - 1 steps from
    their end, and a row further off has one of these on its way: once a round ends none, all that is open hangs on a cycle.
    """
    now = pointers.select(key, "step_key", "up", "last", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open"))
    left = now.count()
    for nth in range(math.ceil(math.log2(left + 1)) + 1):
        ahead = now.select(key, F.col("step_key").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "last", "steps", "open")])
        moved = now.filter("open").join(ahead.hint("merge"), [key, "up"], "left").select(
            key, "step_key", F.coalesce("_up", "up").alias("up"), F.when(F.col("_up").isNull(), F.col("last")).otherwise(F.col("_last")).alias("last"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_open", F.lit(False)).alias("open"),
        )
        then = materialize(now.filter("not open").unionByName(moved) if nth else moved, "pointers")
        if nth:
            discard(now)
        now, before = then, left
        left = now.filter("open").count()
        if left in (0, before):
            break
    return now


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def graph_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, step_key, depth, stuck) of every step.

    Depth is the longest path from a root. ``stuck`` steps lie on or behind a cycle; only the free steps before
    them count for their depth. Edges from or to unknown steps, and repeated edges, don't count.
    """
    keys = materialize(nodes.select(*NODE).distinct(), "graph-nodes")
    known = edges.select("job_id", "from_step_key", "to_step_key").distinct()
    for end in ("from_step_key", "to_step_key"):
        known = known.join(keys.withColumnRenamed("step_key", end), ["job_id", end], "left_semi")
    return _layers(keys, materialize(known, "graph-edges"))


def _layers(keys: DataFrame, known: DataFrame) -> DataFrame:
    """:func:`graph_layers` of stored, distinct steps and edges between them."""
    spark = keys.sparkSession
    needs = known.groupBy("job_id", F.col("to_step_key").alias("step_key")).agg(
        F.count(F.lit(1)).alias("need"), F.min("from_step_key").alias("one")
    )
    steps = materialize(keys.join(needs, NODE, "left").select(*NODE, F.coalesce("need", F.lit(0)).alias("need"), "one"), "graph-steps")
    attached = follow(steps.filter("need = 1").select(*NODE, F.col("one").alias("up"), F.lit(None).cast("boolean").alias("last")), "job_id")

    # Arcs between steps with no or several dependencies, as long as the path they stand for. An arc behind a
    # cycle is left out, so what it leads to is never free.
    several = steps.filter("need > 1").select("job_id", F.col("step_key").alias("to_step_key"), "need")
    through = attached.withColumnRenamed("step_key", "from_step_key")
    arcs = known.join(several, ["job_id", "to_step_key"]).join(through, ["job_id", "from_step_key"], "left").filter("open is null or not open").select(
        "job_id", F.coalesce("up", "from_step_key").alias("from_step_key"), "to_step_key", "need", (F.coalesce("steps", F.lit(0)) + 1).alias("length")
    )
    free_path = scratch_path(spark, "graph-free")
    schema = f"job_id {keys.schema['job_id'].dataType.simpleString()}, step_key string, depth long"
    _append(steps.filter("need = 0").select(*NODE, F.lit(0).cast("long").alias("depth")), free_path)
    arcs = materialize(arcs, "graph-arcs")
    front, partial = spark.read.schema(schema).parquet(free_path), None
    while not arcs.isEmpty():
        arrived = front.withColumnRenamed("step_key", "from_step_key").join(arcs, ["job_id", "from_step_key"]).select(
            "job_id", F.col("to_step_key").alias("step_key"), "need", (F.col("depth") + F.col("length")).alias("depth"), F.lit(1).cast("long").alias("met")
        )
        every = arrived if partial is None else partial.unionByName(arrived)
        step = materialize(every.groupBy(*NODE).agg(F.first("need").alias("need"), F.max("depth").alias("depth"), F.sum("met").alias("met")), "graph-round")
        front, partial = step.filter("met = need").select(*NODE, "depth"), step.filter("met < need")
        if front.isEmpty():
            break
        _append(front, free_path)
    free = spark.read.schema(schema).parquet(free_path)

    # Steps with one dependency stand where they are attached; the rest of the stuck ones keep what reached them.
    above = attached.filter("not open").join(free.withColumnsRenamed({"step_key": "up", "depth": "above"}), ["job_id", "up"])
    depths = free.unionByName(above.select(*NODE, (F.col("above") + F.col("steps")).alias("depth"))).withColumn("stuck", F.lit(False))
    if partial is not None:
        depths = depths.unionByName(partial.select(*NODE, "depth", F.lit(True).alias("stuck")))
    return steps.select(*NODE).join(depths, NODE, "left").select(
        *NODE, F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("stuck", F.lit(True)).alias("stuck")
    )


def reached_from(edges: DataFrame, key: str) -> DataFrame:
    """(key, step_key) of the steps that ``edges`` lead to from the starts.

    ``edges`` is (key, from_step_key, to_step_key, hit), where ``hit`` says that the source is a start; none leads into a
    start. In each phase every step that isn't reached points at one step before it, a reached one if there is
    any, and the pointers are followed: what ends at a reached step is reached. Chains cost a logarithm of rounds; a
    further phase is needed only where the pointer of a step led elsewhere than another of its dependencies does.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "reached")
    left = materialize(edges.select(key, "from_step_key", "to_step_key", "hit"), "reach-edges")
    schema = left.select(key, F.col("to_step_key").alias("step_key")).schema
    left.limit(0).select(key, F.col("to_step_key").alias("step_key")).write.parquet(f"{path}/phase=0")
    phase = 0
    while not left.filter("hit").isEmpty():
        phase += 1
        best = F.struct(~F.col("hit"), F.xxhash64("from_step_key", F.lit(phase)))
        pointed = left.groupBy(key, F.col("to_step_key").alias("step_key")).agg(F.min_by("from_step_key", best).alias("up"), F.bool_or("hit").alias("last"))
        ends = follow(materialize(pointed, "reach-pointers"), key)
        ends.filter("last and not open").select(key, "step_key").write.parquet(f"{path}/phase={phase}")
        new = spark.read.schema(schema).parquet(f"{path}/phase={phase}")
        # Edges into what is reached have done their work; edges out of it lead to the next phase.
        rest = left.drop("hit").join(new.withColumnRenamed("step_key", "to_step_key"), [key, "to_step_key"], "left_anti")
        sources = new.select(key, F.col("step_key").alias("from_step_key"), F.lit(True).alias("found"))
        then = materialize(rest.join(sources, [key, "from_step_key"], "left").select(key, "from_step_key", "to_step_key", F.coalesce("found", F.lit(False)).alias("hit")), "reach-edges")
        discard(left)
        left = then
    return spark.read.schema(schema).parquet(*[f"{path}/phase={i}" for i in range(phase + 1)])


def ancestor_bits(edges: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ancestors of every free step as bit sets (job_id, step_key, word, every, behind), and the edges with their source's bit.

    Steps of a job are numbered by key and 64 of them make a word. ``every`` holds all ancestors in the word,
    ``behind`` those that also lie before one of the step's dependencies. A layer's sets are the union of its dependencies' sets
    and the dependencies themselves, so there is a round per layer and a row per 64 ancestors, none per pair.
    """
    spark = edges.sparkSession
    number = rank_within(layers.filter("not stuck").select(*NODE, "depth"), ["job_id"], [F.col("step_key").asc()], "number")
    steps = materialize(number.withColumn("number", F.col("number") - 1), "numbered-steps")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("number", F.lit(64)).cast("int"))
    sources = steps.select("job_id", F.col("step_key").alias("from_step_key"), F.floor(F.col("number") / 64).alias("word"), bit.alias("bit"))
    targets = steps.select("job_id", F.col("step_key").alias("to_step_key"), "depth")
    links = edges.select("job_id", "from_step_key", "to_step_key").distinct().join(sources, ["job_id", "from_step_key"]).join(targets, ["job_id", "to_step_key"])
    links = materialize(links, "layer-links")
    path = scratch_path(spark, "ancestors")
    schema = f"job_id {steps.schema['job_id'].dataType.simpleString()}, step_key string, word long, every long, behind long"
    spark.createDataFrame([], schema).write.parquet(path)
    for depth in range(1, (steps.agg(F.max("depth")).first()[0] or 0) + 1):
        known = spark.read.schema(schema).parquet(path).select("job_id", F.col("step_key").alias("from_step_key"), F.col("word").alias("far"), "every")
        layer = links.filter(F.col("depth") == depth)
        none = F.lit(0).cast("long")
        direct = layer.select("job_id", F.col("to_step_key").alias("step_key"), "word", F.col("bit").alias("every"), none.alias("behind"))
        further = layer.join(known, ["job_id", "from_step_key"]).select("job_id", F.col("to_step_key").alias("step_key"), F.col("far").alias("word"), "every", F.col("every").alias("behind"))
        _append(direct.unionByName(further).groupBy(*NODE, "word").agg(F.bit_or("every").alias("every"), F.bit_or("behind").alias("behind")), path)
    return spark.read.schema(schema).parquet(path), links


def reduced_edges(edges: DataFrame) -> DataFrame:
    """Edges that no longer path makes redundant; edges into steps on or behind a cycle all stay."""
    distinct = materialize(edges.select("job_id", "from_step_key", "to_step_key").distinct(), "graph-edges")
    # Both ends of an edge without nulls are among the steps, so none has to be looked for.
    known = distinct.filter("job_id is not null and from_step_key is not null and to_step_key is not null")
    ends = distinct.select("job_id", F.explode(F.array("from_step_key", "to_step_key")).alias("step_key")).distinct()
    layers = materialize(_layers(materialize(ends, "graph-nodes"), known), "graph-layers")
    bits, links = ancestor_bits(distinct, layers)
    behind = bits.filter("behind <> 0").select("job_id", F.col("step_key").alias("to_step_key"), "word", "behind")
    redundant = links.join(behind, ["job_id", "to_step_key", "word"]).filter(F.col("behind").bitwiseAND(F.col("bit")) != 0)
    return distinct.join(redundant.select("job_id", "from_step_key", "to_step_key"), ["job_id", "from_step_key", "to_step_key"], "left_anti")
