"""Approximate nearest neighbours by largest inner product: a small-world graph per shard, shard results merged.

1. Equal vectors form a class with its smallest ids, as many as a result can hold; the graphs are over classes, so
   copies neither fill neighbour lists nor split a graph.
2. Classes are dealt by hash to shards of bounded size. One task builds a shard's graph (``small_world``) and
   returns a row per node with its neighbours in all layers as one flat array; the index is a stored table.
3. Queries come in blocks of bounded size, and every block meets every shard of its length in one task, which
   walks the graph in single precision and scores what it found exactly, in double precision on the original vectors.
4. The best of each shard are ranked together. The nodes kept in view start at EF and double until the audit of a
   bounded number of queries against brute force finds the wanted share of true neighbours.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows without id; vectors of different lengths aren't compared; rows that repeat id and vector count once, and an
id with several vectors is a query for each of them and never its own neighbour; equal scores rank by smaller
id; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm import small_world
from flowledger.session import materialize

K = 20
#: Components of all vectors of a shard or of a block of queries, on average; and the least vectors of either.
SHARD_VALUES, BLOCK_VALUES, LEAST_ROWS = 1 << 19, 1 << 18, 64
#: Nodes in view of all queries that a task handles at once, and pairs that it scores at once.
VIEWED, SCORED = 1 << 19, 1 << 16
#: Nodes kept in view, queries of the audit, and the share of true neighbours they must find.
EF, AUDITED, TARGET = 96, 256, 0.97

FOUND = "query_id long, query_key long, vec_id long, score double"


def usable(vec_id: Column, embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(vec_id.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """embedding, key (hash of the vector), ids (its smallest, one more than a result holds)."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.xxhash64("embedding"))


def _dealt(rows: DataFrame, values: int, part: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their length and a part number by hash of ``key``; and the parts per length."""
    sized = rows.withColumn("dim", F.size("embedding"))
    parts = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(
        "dim", F.ceil(F.col("n") / F.greatest(F.floor(F.lit(values) / F.col("dim")), F.lit(LEAST_ROWS))).cast("int").alias(f"{part}s")
    )
    return sized.join(parts, "dim").withColumn(part, F.pmod("key", f"{part}s").cast("int")).drop(f"{part}s"), parts


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _graph(group: pa.Table) -> pa.Table:
    """Rows of one shard with place, level and links added: a node's neighbours in layer 0, then in those above."""
    group = group.take(pc.sort_indices(group, [("key", "ascending")]))
    level = small_world.levels(len(group), seed=int(group.column("shard")[0].as_py()))
    layers = small_world.build(small_world.augmented(_matrix(group.column("embedding"))), level)
    links = [np.concatenate([layer[i] for layer in layers[: level[i] + 1]]) for i in range(len(group))]
    ends = np.cumsum([0, *map(len, links)])
    flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(links), pa.int32()))
    return group.append_column("place", pa.array(np.arange(len(group)), pa.int32())).append_column("level", pa.array(level, pa.int32())).append_column("links", flat)


def build_index(vectors: DataFrame, k: int = K) -> DataFrame:
    """The stored index of (vec_id, embedding) rows that are all usable: one row per distinct vector."""
    nodes, shards = _dealt(materialize(classes(vectors, k), "vector-classes"), SHARD_VALUES, "shard")
    kind = vectors.schema["embedding"].dataType.simpleString()
    many = shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    columns = nodes.select("dim", "shard", "key", "embedding", "ids").repartition(max(2 * many, 1), "dim", "shard")
    schema = f"dim int, shard int, key long, embedding {kind}, ids array<long>, place int, level int, links array<int>"
    return materialize(columns.groupBy("dim", "shard").applyInArrow(_graph, schema), "vector-index")


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equal rows, the same wherever a row stands."""
    return (a * b).sum(axis=1)


def _ranked(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties by smaller id."""
    order = np.lexsort([ids, -score, query])
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[nth < k]


def _expanded(queries: pa.Table, nodes: pa.Table, row: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    """Results of the ids behind (query row, node, score), without the query's own id, the k best of each query."""
    lists = nodes.column("ids").combine_chunks()
    lengths, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    many = lengths[node]
    at = np.repeat(starts[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, score, ids = np.repeat(row, many), np.repeat(score, many), flat[at]
    own = queries.column("vec_id").to_numpy()
    other = own[row] != ids
    row, score, ids = row[other], score[other], ids[other]
    best = _ranked(row, ids, score, k)
    row = row[best]
    return pa.table({"query_id": own[row], "query_key": queries.column("key").to_numpy()[row], "vec_id": ids[best], "score": score[best]})


def _walk(nodes: pa.Table, queries: pa.Table, ef: int, k: int) -> pa.Table:
    """The best of one shard for one block of queries."""
    if not len(nodes) or not len(queries):
        return pa.table({"query_id": pa.array([], pa.int64()), "query_key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    nodes = nodes.take(pc.sort_indices(nodes, [("place", "ascending")])).combine_chunks()
    x, q = _matrix(nodes.column("embedding")), _matrix(queries.column("embedding"))
    level, links = nodes.column("level").to_numpy(), nodes.column("links").combine_chunks()
    flat, starts = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
    layers = []
    for layer in range(int(level[0]) + 1):
        size, width = int((level >= layer).sum()), 2 * small_world.M if layer == 0 else small_world.M
        offset = 0 if layer == 0 else (layer + 1) * small_world.M
        layers.append(flat[starts[:size, None] + offset + np.arange(width)])
    units = q / np.abs(q).max(axis=1, keepdims=True)  # a query's scale doesn't change its order
    zero = np.column_stack([units / np.sqrt((units * units).sum(axis=1, keepdims=True)), np.zeros(len(q))]).astype(np.float32)
    points, ef = small_world.augmented(x), max(ef, k + 1)
    ids = nodes.column("ids").combine_chunks()
    least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    out, many = [], max(1, VIEWED // ef)
    for lo in range(0, len(q), many):
        found = small_world.nearest(points, layers, zero[lo : lo + many], ef)
        row, place = np.nonzero(found >= 0)
        node, row = found[row, place], row + lo
        score = np.concatenate([_score(q[row[i : i + SCORED]], x[node[i : i + SCORED]]) for i in range(0, len(row), SCORED)])
        best = _ranked(row, least[node], score, k + 1)
        out.append(_expanded(queries, nodes, row[best], node[best], score[best], k))
    return pa.concat_tables(out)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def walk_index(index: DataFrame, queries: DataFrame, ef: int, k: int = K) -> DataFrame:
    """query_id, query_key, vec_id, score, rank: what the graphs find for the stored (vec_id, embedding, key) rows."""
    blocked, blocks = _dealt(queries, BLOCK_VALUES, "block")
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    pairs = shards.join(blocks, "dim").agg(F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(0))).first()[0]
    keys = ["dim", "shard", "block"]
    each_shard = blocked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    each_block = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = [
        each_block.select(*keys, "embedding", "ids", "place", "level", "links").repartition(max(2 * pairs, 1), *keys).groupBy(*keys),
        each_shard.select(*keys, "vec_id", "key", "embedding").repartition(max(2 * pairs, 1), *keys).groupBy(*keys),
    ]
    return _top(dealt[0].cogroup(dealt[1]).applyInArrow(lambda nodes, rows: _walk(nodes, rows, ef, k), FOUND), k)


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The true neighbours, as ``walk_index`` gives them, of a bounded number of queries."""
    asked = queries.select("vec_id", "key", "embedding").toArrow()
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    lengths = pc.list_value_length(asked.column("embedding")).to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("embedding")).to_numpy()
            for dim in np.unique(dims):
                mine, rows = batch.filter(pa.array(dims == dim)), asked.filter(pa.array(lengths == dim))
                if not len(rows):
                    continue
                x, ids, own = _matrix(mine.column("embedding")), mine.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
                for i, q in enumerate(_matrix(rows.column("embedding"))):
                    score = _score(np.broadcast_to(q, x.shape), x)
                    score[ids == own[i]] = np.nan
                    least = np.sort(-score[~np.isnan(score)])[:k]
                    keep = np.flatnonzero(-score <= least[-1]) if len(least) else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keep), own[i])), pa.array(np.full(len(keep), rows.column("key")[i].as_py())), pa.array(ids[keep]), pa.array(score[keep])],
                        names=["query_id", "query_key", "vec_id", "score"],
                    )

    return _top(vectors.mapInArrow(compare, FOUND), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the rows of ``true`` that ``found`` has; 1 if there are none."""
    keys = ["query_id", "query_key", "vec_id"]
    hit = true.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return hit[0] / hit[1] if hit[1] else 1.0


def audited_ef(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = K, target: float = TARGET) -> tuple[int, float]:
    """Nodes to keep in view so that the audited queries find the target share, and that share.

    A view as wide as a shard is the whole shard, so the search ends with exact results at the latest.
    """
    some = materialize(queries.orderBy(F.xxhash64("key"), "vec_id").limit(AUDITED), "audited-queries")
    true = materialize(brute_force(vectors, some, k), "true-neighbours")
    most = index.groupBy("dim", "shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    ef = EF
    while True:
        share = recall(walk_index(index, some, ef, k), true)
        if share >= target or ef >= most:
            return ef, share
        ef *= 2


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that meets the condition ``queries``."""
    rows = vectors.filter(usable(F.col(vec_id), F.col(embedding)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asked"))
    plain = rows.select("vec_id", "embedding")
    asked = materialize(rows.filter("asked").select("vec_id", "embedding", F.xxhash64("embedding").alias("key")).distinct(), "vector-queries")
    index = build_index(plain, k)
    ef, _ = audited_ef(index, plain.distinct(), asked, k)
    return walk_index(index, asked, ef, k).select("query_id", "rank", "vec_id", "score")
