"""Depths, cycles, skips and reductions by joins agree with plain walks over the graphs."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from flowledger.catalog import graphs as graph_queries
from flowledger.operators import execution, graph, layers
from flowledger.session import materialize

EDGES = "job_id long, from_step_key string, to_step_key string"
NODES = "job_id long, step_key string"


def random_graphs(seed, jobs=12, cyclic=True):
    rng = random.Random(seed)
    nodes, edges = [], []
    for job in range(jobs):
        keys = [f"n{i:02d}" for i in range(rng.randrange(1, 16))]
        nodes += [(job, k) for k in keys] + [(job, keys[0])]
        for _ in range(rng.randrange(2 * len(keys) + 1)):
            a, b = rng.choice(keys), rng.choice(keys)
            if cyclic and job % 3 == 0 or a < b:
                edges.append((job, a, b))
        edges += [(job, "unknown", keys[0]), (job, keys[-1], "unknown")]
    return nodes, edges


def test_layers_equal_the_order_of_a_task(spark):
    for seed in range(3):
        nodes, edges = random_graphs(seed)
        frames = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
        want = {(r.job_id, r.step_key, r.depth, r.stuck) for r in graph.graph_order(*frames).collect()}
        assert {tuple(r) for r in layers.graph_layers(*frames).select("job_id", "step_key", "depth", "stuck").collect()} == want


def test_layers_of_a_chain_of_100000_steps(spark):
    nodes = spark.range(100_000).select(F.lit(1).cast("long").alias("job_id"), F.col("id").cast("string").alias("step_key"))
    edges = spark.range(99_999).select(F.lit(1).cast("long").alias("job_id"), F.col("id").cast("string").alias("from_step_key"), (F.col("id") + 1).cast("string").alias("to_step_key"))
    wrong = layers.graph_layers(nodes, edges).filter("depth <> cast(step_key as long) or stuck")
    assert wrong.isEmpty()


def test_loops_and_empty_graphs(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], NODES)
    edges = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (2, "a", "b"), (2, "b", "a"), (2, "b", "c")], EDGES)
    assert {(r.job_id, r.step_key, r.depth, r.stuck) for r in layers.graph_layers(nodes, edges).collect()} == {
        (1, "a", 0, True), (1, "b", 0, True), (2, "a", 0, True), (2, "b", 0, True), (2, "c", 0, True)
    }
    assert layers.graph_layers(nodes.limit(0), edges.limit(0)).count() == 0
    assert layers.reduced_edges(edges.limit(0)).count() == 0


def test_skips_against_a_walk(spark):
    rng = random.Random(8)
    for seed in (4, 5):
        nodes, edges = random_graphs(seed)
        state = {n: rng.choice(["pending"] * 4 + ["success", "failed", "skipped"]) for n in dict.fromkeys(nodes)}
        reached, front = set(), [n for n, s in state.items() if s in ("failed", "skipped")]
        while front:
            job, key = front.pop()
            for j, a, b in edges:
                if (j, a) == (job, key) and state.get((j, b)) == "pending" and (j, b) not in reached:
                    reached.add((j, b))
                    front.append((j, b))
        steps = spark.createDataFrame([(*n, s) for n, s in state.items()], "run_id long, step_key string, status string")
        runs = spark.createDataFrame(edges, EDGES).withColumnRenamed("job_id", "run_id")
        got = execution.skipped_steps(steps, runs).select("run_id", "step_key").collect()
        assert len(got) == len(reached) and {tuple(r) for r in got} == reached


def test_reduction_against_a_walk(spark):
    nodes, edges = random_graphs(9, cyclic=False)
    edges = [e for e in edges if "unknown" not in e]
    nodes += [(99, f"m{i:03d}") for i in range(150)]
    rng = random.Random(1)
    edges += [(99, f"m{a:03d}", f"m{b:03d}") for a in range(150) for b in rng.sample(range(a + 1, 150), min(3, 149 - a))]
    after = {}
    for j, a, b in edges:
        after.setdefault((j, a), set()).add(b)

    def below(job, key, seen):
        for b in after.get((job, key), ()):
            if b not in seen:
                seen.add(b)
                below(job, b, seen)
        return seen

    want = {(j, a, b) for j, a, b in edges if not any(b in below(j, m, set()) for m in after[j, a] if m != b)}
    got = layers.reduced_edges(spark.createDataFrame(edges, EDGES)).select("job_id", "from_step_key", "to_step_key").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rounds_of_pointers_send_no_side_through_the_driver(spark, monkeypatch):
    plans = []

    def stored(rows, label):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return materialize(rows, label)

    monkeypatch.setattr(layers, "materialize", stored)
    pointers = spark.range(1, 40).selectExpr("1L as job_id", "cast(id as string) as step_key", "cast(id - 1 as string) as up", "false as last")
    ends = layers.follow(materialize(pointers, "chain"), "job_id")
    assert {(int(r.step_key), r.up, r.steps, r.open) for r in ends.collect()} == {(i, "0", i, False) for i in range(1, 40)}
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans)


def test_cycles_cost_no_more_rounds_than_the_chains_beside_them(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(layers, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    ring = [(1, f"r{i:04d}", f"r{(i + 1) % 2000:04d}") for i in range(2000)]
    chain = [(2, f"c{i}", f"c{i + 1}") for i in range(20)] + [(1, "t0", "r0000"), (2, "x", "x")]
    pointers = spark.createDataFrame([(*row, row[1] == "c19") for row in ring + chain], "job_id long, step_key string, up string, last boolean")
    ends = layers.follow(materialize(pointers, "rings"), "job_id")
    got = {(r.step_key, r.up, r.steps, r.last) for r in ends.filter("not open").collect()}
    assert got == {(f"c{i}", "c20", 20 - i, True) for i in range(20)}
    assert ends.filter("open").count() == 2002
    assert len(rounds) == 6  # one that ends none after chains of 20 to 31 steps; by the rows alone it would be 12


def test_reduction_takes_its_edges_as_known(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(layers, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "a", "b"), (1, None, "c"), (1, "d", None), (None, "a", "b"), (2, "x", "x")]
    got = layers.reduced_edges(spark.createDataFrame(edges, EDGES)).select("job_id", "from_step_key", "to_step_key").collect()
    assert {tuple(r) for r in got} == set(edges) - {(1, "a", "c")} and len(got) == 6
    assert labels.count("graph-edges") == 1


def test_spans_read_the_stored_edges(spark, tmp_path):
    path = str(tmp_path / "edges")
    spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "a", "gone")], EDGES).write.parquet(path)
    nodes = spark.createDataFrame([(1, k) for k in "abc"], NODES)
    spans = graph_queries._edge_spans(SimpleNamespace(job_nodes=nodes, job_edges=spark.read.parquet(path)))
    assert not any(path in file for file in spans.inputFiles())
    got = {(r.from_step_key, r.to_step_key, r.from_depth, r.to_depth, r.long_span, r.back_edge) for r in spans.collect()}
    assert got == {("a", "b", 0, 1, False, False), ("b", "c", 1, 2, False, False), ("a", "c", 0, 2, True, False)}


def test_errors_count_the_steps_once(spark, tmp_path):
    path = str(tmp_path / "nodes")
    spark.createDataFrame([(1, "a"), (1, "a"), (1, ""), (None, "a"), (2, None)], NODES).write.parquet(path)
    edges = spark.createDataFrame([(1, "a", "b"), (1, "z", "a"), (None, "a", "b")], EDGES)
    errors = graph.graph_errors(spark.createDataFrame([(1,), (2,), (3,), (None,)], "job_id long"), spark.read.parquet(path), edges)
    assert not any(path in file for file in errors.inputFiles())
    assert sorted(map(tuple, errors.collect()), key=repr) == sorted([
        (1, "empty step key", "", "1"), (1, "duplicate step", "a", "2"), (1, "unknown dependency", "a", "z"),
        (None, "unknown dependency", "b", "a"), (3, "no steps", "", ""), (None, "no steps", "", ""),
    ], key=repr)


def test_degrees_join_the_edges_once(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (None, "a"), (2, "x")], NODES)
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "z", "a"), (1, None, "b"), (None, "a", "b"), (2, "x", "x")], EDGES)
    degrees = graph.degrees(nodes, edges)
    assert degrees._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert sorted(map(tuple, degrees.collect()), key=repr) == sorted([
        (1, "a", 0, 1, True, False), (1, "b", 1, 0, False, True), (1, None, 0, 0, True, True),
        (None, "a", 0, 0, True, True), (2, "x", 1, 1, False, False),
    ], key=repr)
