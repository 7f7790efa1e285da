"""Dependency graphs of many jobs at once.

``nodes`` is (job_id, step_key, ...) and ``edges`` is (job_id, from_step_key, to_step_key), where the
target depends on the source. Iterative operators write each round to the shared scratch folder, so
plans stay short and a lost executor repeats one round at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.functions.text import clean
from flowledger.session import materialize

NODE = ["job_id", "step_key"]
EDGE = ["job_id", "from_step_key", "to_step_key"]


def edges_of_dependencies(nodes: DataFrame) -> DataFrame:
    """Edges from the ``depends_on`` list in each node's metadata."""
    depends_on = F.from_json("metadata_json", "depends_on array<string>")["depends_on"]
    return nodes.select("job_id", F.explode(depends_on).alias("from_step_key"), F.col("step_key").alias("to_step_key"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges whose both ends are nodes."""
    keys = nodes.select(*NODE).distinct()
    return (
        edges.select(*EDGE)
        .distinct()
        .join(keys.withColumnRenamed("step_key", "from_step_key"), ["job_id", "from_step_key"], "left_semi")
        .join(keys.withColumnRenamed("step_key", "to_step_key"), ["job_id", "to_step_key"], "left_semi")
        .select(*EDGE)
    )


def graph_errors(jobs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural errors as (job_id, problem, subject, detail); cycles are found by ``graph_layers``."""

    def found(rows: DataFrame, problem: str, subject: Column, detail: Column) -> DataFrame:
        return rows.select(
            "job_id", F.lit(problem).alias("problem"), subject.alias("subject"), detail.cast("string").alias("detail")
        )

    counted = materialize(nodes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")), "counted-steps")  # read four times
    known = counted.select("job_id", F.col("step_key").alias("from_step_key"))
    unknown = edges.join(known, ["job_id", "from_step_key"], "left_anti")
    empty = jobs.select("job_id").join(counted.select("job_id"), "job_id", "left_anti")
    none = F.lit("")
    return (
        found(counted.filter("step_key = ''"), "empty step key", none, F.col("n"))
        .unionByName(found(counted.filter("step_key <> '' and n > 1"), "duplicate step", F.col("step_key"), F.col("n")))
        .unionByName(found(unknown, "unknown dependency", F.col("to_step_key"), F.col("from_step_key")))
        .unionByName(found(empty, "no steps", none, none))
    )


def schedule_key_errors(schedules: DataFrame) -> DataFrame:
    """Empty or repeated schedule keys per job."""
    counted = schedules.groupBy("job_key", clean(F.col("schedule_key")).alias("schedule_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    problem = F.when(F.col("schedule_key") == "", F.lit("empty schedule key")).when(
        F.col("n") > 1, F.lit("duplicate schedule key")
    )
    return counted.withColumn("problem", problem).filter("problem is not null")


def graph_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Execution order and depth: (job_id, step_key, depth, topo_index, stuck).

    The order takes, again and again, the smallest key among the steps whose dependencies are all
    taken; depth is the longest path from a root. ``stuck`` steps lie on or behind a cycle and come
    last in key order. Each choice depends on all before it, so a graph is ordered by one task: rows are
    shuffled and sorted by job, and one graph at a time is held. The graph of a job must fit a task.
    """
    rows = (
        nodes.select(*NODE, F.lit(None).cast("string").alias("to_step_key"))
        .unionByName(edges.select("job_id", F.col("from_step_key").alias("step_key"), "to_step_key"))
        .repartition("job_id")
        .sortWithinPartitions("job_id")
    )
    dtype = nodes.schema["job_id"].dataType.simpleString()
    return rows.mapInPandas(
        _order_graphs, f"job_id {dtype}, step_key string, depth long, topo_index long, stuck boolean"
    )


def _order_graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["job_id", "step_key", "depth", "topo_index", "stuck"]
    job, steps, arcs = None, set(), set()
    for batch in batches:
        done = []
        for job_id, source, target in zip(batch.job_id.tolist(), batch.step_key, batch.to_step_key):
            if job_id != job:
                if job is not None:
                    done += _order_one(job, steps, arcs)
                job, steps, arcs = job_id, set(), set()
            if target is None:
                steps.add(source)
            else:
                arcs.add((source, target))
        yield pd.DataFrame(done, columns=columns)
    if job is not None:
        yield pd.DataFrame(_order_one(job, steps, arcs), columns=columns)


def _order_one(job, steps: set[str], arcs: set[tuple[str, str]]) -> list[tuple]:
    """Rows of one graph: smallest ready key first, then whatever a cycle holds back."""
    after: dict[str, list[str]] = {step: [] for step in steps}
    need = dict.fromkeys(steps, 0)
    depth = dict.fromkeys(steps, 0)
    for source, target in arcs:
        if source in steps and target in steps:
            after[source].append(target)
            need[target] += 1
    ready = [step for step in steps if not need[step]]
    heapq.heapify(ready)
    order = []
    while ready:
        step = heapq.heappop(ready)
        order.append(step)
        for target in after[step]:
            depth[target] = max(depth[target], depth[step] + 1)
            need[target] -= 1
            if not need[target]:
                heapq.heappush(ready, target)
    free = len(order)
    order += sorted(steps.difference(order))
    return [(job, step, depth[step], place, place >= free) for place, step in enumerate(order)]


def cyclic_jobs(order: DataFrame) -> DataFrame:
    """Jobs whose graph has a cycle, self-loops included, with the steps on or behind it."""
    return order.filter("stuck").groupBy("job_id").agg(F.count(F.lit(1)).alias("stuck_steps"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies and dependents of every step, one per row; unknown steps dropped."""
    links = known_edges(nodes, edges)
    down = links.select(
        "job_id", F.col("to_step_key").alias("step_key"), F.lit("depends_on").alias("side"), F.col("from_step_key").alias("other")
    )
    up = links.select(
        "job_id", F.col("from_step_key").alias("step_key"), F.lit("needed_by").alias("side"), F.col("to_step_key").alias("other")
    )
    return down.unionByName(up)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree of every step, and whether it is a root or a sink."""
    links = known_edges(nodes, edges)
    # Both ends come from one pass over the links, so no task joins them twice.
    sides = [F.struct(F.col(end).alias("step_key"), F.lit(i).alias("i"), F.lit(1 - i).alias("o")) for end, i in (("to_step_key", 1), ("from_step_key", 0))]
    ends = links.select("job_id", F.inline(F.array(*sides)))
    every = nodes.select(*NODE).distinct().withColumns({"i": F.lit(0), "o": F.lit(0)}).unionByName(ends)
    counted = every.groupBy(*NODE).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return counted.withColumns({"is_root": F.col("in_degree") == 0, "is_sink": F.col("out_degree") == 0})


def edge_spans(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with the depth of both ends: long ones skip a layer, back edges do not go deeper."""
    depth = order.select(*NODE, "depth")
    source = depth.withColumnsRenamed({"step_key": "from_step_key", "depth": "from_depth"})
    target = depth.withColumnsRenamed({"step_key": "to_step_key", "depth": "to_depth"})
    return (
        edges.select(*EDGE)
        .join(source, ["job_id", "from_step_key"])
        .join(target, ["job_id", "to_step_key"])
        .withColumns(
            {
                "long_span": F.col("to_depth") - F.col("from_depth") >= 2,
                "back_edge": F.col("from_depth") >= F.col("to_depth"),
            }
        )
    )


def neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each step with itself and its direct dependencies and dependents."""
    near = adjacency(nodes, edges).select(*NODE, F.col("other").alias("related"))
    own = nodes.select(*NODE, F.col("step_key").alias("related"))
    return own.unionByName(near).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """Pairs (job_id, from_step_key, to_step_key, indirect) joined by a path of any length.

    The result is the closure itself, so within one graph it grows with the square of its steps.

    Each round doubles the path length covered, so a chain of n steps needs log2(n) rounds: with R
    all pairs up to length k and P those joined by a walk of exactly k, R grows by P after R. A pair
    is ``indirect`` when some path between its ends has more than one edge.
    """
    pairs = materialize(edges.select(*EDGE).distinct().withColumn("indirect", F.lit(False)), "reach-pairs")
    walks = pairs.select(*EDGE)
    known = pairs.count()
    while not walks.isEmpty():
        first = walks.withColumnRenamed("to_step_key", "middle")
        longer = first.join(pairs.withColumnRenamed("from_step_key", "middle"), ["job_id", "middle"]).select(
            *EDGE, F.lit(True).alias("indirect")
        )
        pairs = materialize(
            pairs.unionByName(longer).groupBy(*EDGE).agg(F.bool_or("indirect").alias("indirect")), "reach-pairs"
        )
        grown = pairs.count()
        if grown == known and _has_cycle(pairs):
            break
        known = grown
        second = walks.withColumnRenamed("from_step_key", "middle")
        walks = materialize(first.join(second, ["job_id", "middle"]).select(*EDGE).distinct(), "reach-walks")
    return pairs


def _has_cycle(pairs: DataFrame) -> bool:
    return not pairs.filter("from_step_key = to_step_key").isEmpty()
