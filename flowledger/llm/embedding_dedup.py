"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of a label form a class; only its smallest id takes part further, with the class's size.
2. A first neighbour graph comes from random projections: vectors are ordered by the signs of their
   projections and compared within short runs of that order, for several projections.
3. A round of the descent joins each node's neighbours, forward and backward, and compares them with one
   another; what beats a node's worst neighbour enters its list. A list whose entries all reach the
   threshold is saturated, and doubles.
4. Links at the threshold give the components. A component with more nodes than a list has entries can fill its
   members' lists and hide a weaker link to another one, so the descent goes on between components: the members of
   such components keep lists of neighbours in other components only, until no round finds a link between two
   components and hardly anything enters a list. What it links is one component from then on.
5. The recall of links is audited against brute force for a bounded number of nodes, half of them drawn from all nodes
   and half one per component; below the target, further projections and rounds follow, until it is met.
6. Within each component every pair is then compared exactly, in blocks of
   bounded size that are counted and not listed, so the number of links is exact for what the descent connected.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, and a vector
without label, links with nothing and is its own component; vectors of different lengths don't link; rows
that repeat an id count as vectors of their own with that id; a null id is a component of its own; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.components import connected_components
from flowledger.session import discard, materialize

THRESHOLD = 0.93
NEIGHBOURS = 8
TABLES, BITS, RUN = 4, 32, 64
#: Rounds at most, and the share of entries below which a round that brought so few is the last.
ROUNDS, SETTLED = 3, 0.01
#: Nodes whose links are found by brute force to measure recall, and the share that must be found.
AUDITED, TARGET = 256, 0.99
#: Rows of a block of a large component.
CHUNK = 256

EDGES = "u long, v long, sim double"


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over batch ends; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _top(sims: np.ndarray, k: int, floor: np.ndarray | float = -2.0, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k best entries above the row's floor; with ``part``, among the columns of other parts."""
    sims = sims.copy()
    np.fill_diagonal(sims, -3)
    if part is not None:
        sims[part[:, None] == part[None, :]] = -3
    best = np.zeros(sims.shape, bool)
    k = min(k, len(sims) - 1)
    if k > 0:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        np.put_along_axis(best, at, True, axis=1)
    best &= sims > np.reshape(floor, (-1, 1))
    return np.nonzero(best)


def classes(vectors: DataFrame) -> DataFrame:
    """node (smallest vec_id), size, label, embedding: one row per distinct valid vector of a label."""
    return vectors.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))


def usable() -> Column:
    """Whether a row's vector can link at all."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & nonzero, F.lit(False))


def projected(nodes: DataFrame, tables: list[int]) -> DataFrame:
    """Neighbours within short runs of the order of projection signs; where ``nodes`` tell their component, those in other components."""
    apart = "component" in nodes.columns
    extra = ["component"] if apart else []

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                x = _vectors(part.column("embedding"))
                for t in tables:
                    planes = np.random.default_rng([t, x.shape[1]]).normal(size=(x.shape[1], BITS))
                    code = ((x @ planes) > 0).astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t), pa.int32()), part.column("label"), pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(code), part.column("node"), part.column("embedding"), *(part.column(c) for c in extra)],
                        names=["t", "label", "dim", "code", "node", "embedding", *extra],
                    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _cut(batches, ["t", "label", "dim"], RUN):
            if group.num_rows > 1:
                x, ids = _vectors(group.column("embedding").combine_chunks()), group.column("node").to_numpy()
                sims = x @ x.T
                i, j = _top(sims, NEIGHBOURS, part=group.column("component").to_numpy() if apart else None)
                yield _edges(ids[i], ids[j], sims[i, j])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    coded = nodes.select("node", "label", "embedding", *extra).mapInArrow(
        signs, f"t int, label {kinds['label']}, dim int, code long, node long, embedding {kinds['embedding']}" + ", component long" * apart
    )
    keys = ["t", "label", "dim", "code", "node"]
    return coded.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(runs, EDGES)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    lengths = pc.list_value_length(batch.column("embedding"))
    for n in pc.unique(lengths).to_pylist():
        yield batch.filter(pc.equal(lengths, n))


def _cut(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """As _groups, in runs of bounded length; nothing longer is held."""

    def pieces():
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                yield batch.slice(lo, most)

    rest: pa.Table | None = None
    for piece in pieces():
        for group in _groups(iter([piece]), keys):
            key = [group.column(k)[0] for k in keys]
            if rest is not None and [rest.column(k)[0] for k in keys] != key:
                yield rest
                rest = None
            rest = group if rest is None else pa.concat_tables([rest, group])
            while rest.num_rows >= most:
                yield rest.slice(0, most)
                rest = rest.slice(most) if rest.num_rows > most else None
                if rest is None:
                    break
    if rest is not None:
        yield rest


def lists(edges: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """u, v, sim, rank, k, entered: each node's list, as long as ``sizes`` (u, k) says and with every entry at the threshold.

    ``edges`` says of each entry whether it is ``new``; one that is found again isn't.
    """
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("entered"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    k = F.coalesce("k", F.lit(NEIGHBOURS))
    return ranked.join(sizes, "u", "left").filter((F.col("rank") <= k) | (F.col("sim") >= threshold)).select("u", "v", "sim", "rank", k.alias("k"), "entered")


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: pairs among the neighbours of each node that beat the worst entry of a list."""
    floors = graph.groupBy("u").agg(F.min(F.when(F.col("rank") <= F.col("k"), F.col("sim"))).alias("worst"), F.count("*").alias("n"), F.max("k").alias("k"))
    floors = floors.select(F.col("u").alias("node"), F.when(F.col("n") >= F.col("k"), F.col("worst")).otherwise(-2.0).alias("floor"))
    near = graph.filter("rank <= k").select(F.col("u").alias("at"), F.col("v").alias("node"), "sim", "k")
    back = graph.filter("rank <= k").select(F.col("v").alias("at"), F.col("u").alias("node"), "sim", "k")
    back = back.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("sim"), "node"))).filter(F.col("nth") <= 2 * F.col("k")).drop("nth")
    own = nodes.select(F.col("node").alias("at"), "node")
    members = near.select("at", "node").union(back.select("at", "node")).union(own).distinct()
    held = members.join(nodes.select("node", "embedding").join(floors, "node", "left"), "node").select("at", "node", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        for group in _groups(batches, ["at"]):
            if group.num_rows < 2:
                continue
            x, ids = _vectors(group.column("embedding").combine_chunks()), group.column("node").to_numpy()
            sims = x @ x.T
            i, j = _top(sims, NEIGHBOURS, group.column("floor").to_numpy())
            found.append((ids[i], ids[j], sims[i, j]))
            size += len(i)
            if size > 50_000:
                yield _edges(*map(np.concatenate, zip(*found, strict=True)))
                found, size = [], 0
        if found:
            yield _edges(*map(np.concatenate, zip(*found, strict=True)))

    return held.repartition("at").sortWithinPartitions("at").mapInArrow(compare, EDGES).groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _across(edges: DataFrame, where: DataFrame) -> DataFrame:
    """u, v, sim, new, rank of the best entries that lead from a large component to another one; ``where`` is (node, component, large)."""
    known = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    known = known.join(where.select(F.col("node").alias("u"), F.col("component").alias("cu"), "large"), "u").filter("large")
    known = known.join(where.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").filter("cu <> cv")
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    return ranked.filter(F.col("rank") <= NEIGHBOURS).select("u", "v", "sim", "new", "rank")


def descend_across(across: DataFrame, graph: DataFrame, nodes: DataFrame, where: DataFrame) -> DataFrame:
    """One round between components: u, v, sim of pairs that beat the worst entry of u's list ``across``.

    At each node meet its own neighbours and those across, forward and backward, so what one member of a
    component knows of other components reaches the members around it.
    """
    known = graph.filter(F.col("rank") <= NEIGHBOURS).select("u", "v", "sim").union(across.select("u", "v", "sim"))
    back = known.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).filter(F.col("nth") <= 2 * NEIGHBOURS)
    own = where.select(F.col("node").alias("at"), "node")
    members = known.select(F.col("u").alias("at"), F.col("v").alias("node")).union(back.select(F.col("v").alias("at"), F.col("u").alias("node"))).union(own).distinct()
    # only where a member of a large component meets another component is there anything to compare
    placed = members.join(where, "node")
    useful = placed.groupBy("at").agg(F.bool_or("large").alias("any"), (F.min("component") != F.max("component")).alias("two")).filter("any and two").select("at")
    floors = across.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).filter(F.col("n") >= NEIGHBOURS).select(F.col("u").alias("node"), F.col("worst").alias("floor"))
    floor = F.when(F.col("large"), F.coalesce("floor", F.lit(-2.0))).otherwise(2.0)
    held = placed.join(useful, "at", "left_semi").join(floors, "node", "left").join(nodes.select("node", "embedding"), "node")
    held = held.select("at", "node", "component", floor.alias("floor"), "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["at"]):
            x, ids = _vectors(group.column("embedding").combine_chunks()), group.column("node").to_numpy()
            sims = x @ x.T
            i, j = _top(sims, NEIGHBOURS, group.column("floor").to_numpy(), group.column("component").to_numpy())
            yield _edges(ids[i], ids[j], sims[i, j])

    return held.repartition("at").sortWithinPartitions("at").mapInArrow(compare, EDGES).groupBy("u", "v").agg(F.max("sim").alias("sim"))


def joined_components(links: DataFrame, graph: DataFrame, nodes: DataFrame, tables: list[int], threshold: float) -> DataFrame:
    """node, component over ``links`` (a, b) and those that the descent between components finds."""
    found, across = links, None
    while True:
        parts = materialize(connected_components(found), "vector-components")
        large = parts.groupBy("component").agg((F.count("*") > NEIGHBOURS).alias("large")).filter("large")
        if large.isEmpty():
            return parts
        where = nodes.select("node").join(parts, "node", "left").join(large, "component", "left")
        where = materialize(where.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("large", F.lit(False)).alias("large")), "vector-places")
        # with the components of now: other lists have become stale, other components large
        seeds = _both(projected(nodes.join(where.select("node", "component"), "node"), tables), 0).union(_old(graph))
        if across is not None:
            seeds = seeds.union(across.select("u", "v", "sim", F.lit(0).alias("new")))
        across = materialize(_across(seeds, where), "neighbours-across")
        while True:
            edges = across.select("u", "v", "sim", F.lit(0).alias("new")).union(_both(descend_across(across, graph, nodes, where), 1))
            then = materialize(_across(edges, where), "neighbours-across")
            discard(across)
            across = then
            entered, total, linked = then.agg(F.coalesce(F.sum("new"), F.lit(0)), F.count("*"), F.count(F.when(F.col("sim") >= threshold, 1))).first()
            if linked or entered <= SETTLED * total:
                break
        if not linked:
            return parts
        found = found.union(materialize(across.filter(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")), "links-across"))
        discard(where)


def audit_recall(parts: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> tuple[int, int]:
    """(links whose ends ``parts`` (node, component) joins, links there are) of a bounded number of nodes, by brute force.

    A link within a component is counted exactly later, so a link is found when both ends are in one component.
    Half of the nodes stand for components, else large ones would hide what the small ones lack.
    """
    order = F.xxhash64("node")
    firsts = parts.groupBy("component").agg(F.min_by("node", order).alias("node")).select("node")
    chosen = nodes.select("node").orderBy(order).limit(audited // 2).union(firsts.orderBy(order).limit(audited // 2)).distinct()
    queries = nodes.join(chosen, "node", "left_semi").select("node", "label", "embedding").toArrow()
    if not queries.num_rows:
        return 0, 0
    ids, labels = queries.column("node").to_numpy(), np.array(queries.column("label").to_pylist(), dtype=object)
    embedding = queries.column("embedding").combine_chunks()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        lengths = pc.list_value_length(embedding).to_numpy(zero_copy_only=False)
        for batch in batches:
            for part in _by_length(batch):
                x, own = _vectors(part.column("embedding")), np.array(part.column("label").to_pylist(), dtype=object)
                fits = np.flatnonzero(lengths == x.shape[1])
                if not len(fits):
                    continue
                for lo in range(0, len(x), 4096):
                    sims = _vectors(embedding.take(pa.array(fits))) @ x[lo : lo + 4096].T
                    i, j = np.nonzero((sims >= threshold) & (labels[fits][:, None] == own[None, lo : lo + 4096]))
                    u, v = ids[fits[i]], part.column("node").to_numpy()[lo : lo + 4096][j]
                    yield _edges(u[u != v], v[u != v], sims[i, j][u != v])

    there = nodes.select("node", "label", "embedding").mapInArrow(brute, EDGES)
    ends = there.join(parts.toDF("u", "cu"), "u", "left").join(parts.toDF("v", "cv"), "v", "left")
    found = ends.agg(F.count(F.when(F.col("cu") == F.col("cv"), 1)), F.count("*")).first()
    return found[0], found[1]


def refined(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The lists after rounds of the descent, written to the scratch folder."""
    for _ in range(ROUNDS):
        edges = _old(graph).union(_both(descend(graph, nodes), 1))
        then = materialize(lists(edges, _list_sizes(graph, threshold), threshold), "neighbours")
        entered, total = then.agg(F.coalesce(F.sum("entered"), F.lit(0)), F.count("*")).first()
        discard(graph)
        graph = then
        if entered <= SETTLED * total:
            break
    return graph


def connected(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, component of every node with a link: the descent, the links it gives, and the audit of their recall."""
    sizes = nodes.sparkSession.createDataFrame([], "u long, k int")
    graph = materialize(lists(_both(projected(nodes, list(range(TABLES))), 1), sizes, threshold), "neighbours")
    tables = list(range(TABLES))
    while True:
        graph = refined(graph, nodes, threshold)
        links = graph.filter((F.col("sim") >= threshold) & (F.col("u") < F.col("v"))).select(F.col("u").alias("a"), F.col("v").alias("b"))
        parts = joined_components(links, graph, nodes, tables, threshold)
        found, there = audit_recall(parts, nodes, threshold)
        if found >= TARGET * there:
            return parts
        tables = [t + TABLES for t in tables]
        graph = materialize(lists(_both(projected(nodes, tables), 1).union(_old(graph)), _list_sizes(graph, threshold), threshold), "neighbours")


def _both(edges: DataFrame, new: int) -> DataFrame:
    flag = F.lit(new).alias("new")
    return edges.select("u", "v", "sim", flag).union(edges.select("v", "u", "sim", flag))


def _old(graph: DataFrame) -> DataFrame:
    return graph.select("u", "v", "sim", F.lit(0).alias("new"))


def _list_sizes(graph: DataFrame, threshold: float) -> DataFrame:
    """u, k: lists whose k best entries all reach the threshold double."""
    full = graph.groupBy("u").agg(F.sum(F.when(F.col("sim") >= threshold, 1).otherwise(0)).alias("n"), F.max("k").alias("k"))
    return full.select("u", F.when(F.col("n") >= F.col("k"), F.col("k") * 2).otherwise(F.col("k")).alias("k"))


def component_links(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """node, links: over all pairs of a component, how many vectors of other classes reach the threshold.

    A component is cut into chunks by hash, and each pair of chunks is a block of bounded size.
    """
    many = parts.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = parts.join(many, "component").join(nodes, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "size", "embedding"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["component", "i", "j"]):
            x, ids = _vectors(group.column("embedding").combine_chunks()), group.column("node").to_numpy()
            chunk, size = group.column("chunk").to_numpy(), group.column("size").to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                near &= chunk[:, None] != chunk[None, :]
            links = near @ size
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links, pa.int64())], names=["node", "links"])

    keys = ["component", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    nodes = materialize(classes(rows.filter(usable())), "vector-classes")
    parts = connected(nodes, threshold)
    counted = component_links(nodes, parts, threshold)
    per_class = nodes.join(parts, "node", "left").join(counted, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    good = rows.filter(usable()).join(per_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
