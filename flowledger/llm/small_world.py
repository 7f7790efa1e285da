"""A hierarchical navigable small-world graph over vectors, as flat neighbour arrays, for one shard.

Nodes are numbered by falling level, so layer l consists of the first ``sizes[l]`` nodes and each layer is one flat
array of ``sizes[l]`` rows of neighbour numbers, -1 where a row has fewer. Layers are built from the top: nodes enter
in batches, each searched for in the layer as it is so far, entered from the layers above, linked to diverse near nodes, and linked
back; rows that overflow are chosen anew by the same rule. All searches of a batch advance together.

Nearness is the inner product. Vectors get one more component that makes their norms equal, so that it ranks
neighbours as the Euclidean distance does; queries have zero there, so for them it is the inner product itself.
"""

from __future__ import annotations

import numpy as np

M = 16
#: Nodes kept in view while a node is inserted, and those among which its neighbours are chosen.
EF_BUILD, CHOICE = 64, 40
#: Nodes expanded at once, first and largest batch, nodes kept in view in upper layers.
STEP, FIRST, BATCH, EF_UPPER = 4, 256, 512, 4
#: Searches that advance together.
TOGETHER = 256


def augmented(vectors: np.ndarray) -> np.ndarray:
    """Single-precision vectors of one norm, at most 1, that rank as the given ones do."""
    x = vectors.astype(np.float64)
    x = x / max(np.abs(x).max(initial=0.0), 1e-300)  # so that squares neither overflow nor vanish
    square = (x * x).sum(axis=1)
    most = square.max(initial=0.0)
    return (np.column_stack([x, np.sqrt(np.maximum(most - square, 0.0))]) / np.sqrt(max(most, 1e-300))).astype(np.float32)


def levels(n: int, seed: int) -> np.ndarray:
    """A level per node, falling: each level holds one in M of the nodes below it."""
    draws = 1.0 - np.random.default_rng(seed).random(n)
    return -np.sort(-np.floor(-np.log(draws) / np.log(M)).astype(np.int64))


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes found for each query and their nearness, nearest first; -1 where there are fewer."""
    if len(queries) > TOGETHER:
        parts = [beam(points, links, queries[i : i + TOGETHER], entry[i : i + TOGETHER], ef) for i in range(0, len(queries), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    count, width = len(queries), links.shape[1]
    mark = np.full((count, len(links)), -1, np.int32)
    ids, near = np.full((count, ef), -1, np.int64), np.full((count, ef), -np.inf, np.float32)
    every = np.arange(count)
    ids[:, 0], near[:, 0] = entry, np.einsum("ij,ij->i", queries, points[entry])
    mark[every, entry] = 0
    fresh = np.zeros((count, ef), bool)
    fresh[:, 0] = True
    active = every
    while len(active):
        waiting = np.where(fresh[active], near[active], -np.inf)
        pick = np.argpartition(-waiting, min(STEP, ef) - 1, axis=1)[:, :STEP]
        chosen = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        alive = chosen.any(axis=1)
        active, pick, chosen = active[alive], pick[alive], chosen[alive]
        if not len(active):
            break
        row = active[:, None]
        nodes = ids[row, pick]
        fresh[row, pick] = False
        around = np.where(chosen[:, :, None], links[nodes], -1).reshape(len(active), -1)
        r, c = np.nonzero(around >= 0)
        v = around[r, c]
        unseen = mark[active[r], v] < 0
        r, c, v = r[unseen], c[unseen], v[unseen]
        turn = np.arange(len(v), dtype=np.int32)
        mark[active[r], v] = turn
        once = mark[active[r], v] == turn
        r, c, v = r[once], c[once], v[once]
        found = np.full((len(active), pick.shape[1] * width), -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", queries[active[r]], points[v])
        pool = np.concatenate([near[active], found], axis=1)
        best = np.argpartition(-pool, ef - 1, axis=1)[:, :ef]
        near[active] = np.take_along_axis(pool, best, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], around], axis=1), best, axis=1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], found > -np.inf], axis=1), best, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    return np.where(near > -np.inf, np.take_along_axis(ids, order, axis=1), -1), near


def diverse(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (nearest first): those nearer to the row's node than to any chosen so far, then the nearest others."""
    vectors = points[np.maximum(ids, 0)]
    among = vectors @ vectors.transpose(0, 2, 1)
    there = ids >= 0
    kept, closest, count = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32), np.zeros(len(ids), np.int64)
    for i in range(ids.shape[1]):
        take = there[:, i] & (near[:, i] > closest[:, i]) & (count < most)
        kept[:, i] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, among[:, i]), closest)
    rank = np.arange(ids.shape[1])[None, :] + np.where(kept, 0, ids.shape[1]) + np.where(there, 0, 2 * ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(ids, order, axis=1)


def _sorted(ids: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.where(ids >= 0, near, -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)


def _link_back(points: np.ndarray, links: np.ndarray, nodes: np.ndarray, targets: np.ndarray) -> None:
    """Enter each node into its targets' rows; rows that overflow keep a diverse choice."""
    width = links.shape[1]
    i, j = np.nonzero(targets >= 0)
    to, by = targets[i, j], nodes[i]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    nth = np.arange(len(to)) - np.repeat(starts, np.diff(np.r_[starts, len(to)]))
    for lo in range(0, int(nth.max(initial=-1)) + 1, width):
        some = (nth >= lo) & (nth < lo + width)
        rows, place = np.unique(to[some], return_inverse=True)
        more = np.full((len(rows), width), -1, np.int64)
        more[place, nth[some] - lo] = by[some]
        pool = np.concatenate([links[rows].astype(np.int64), more], axis=1)
        full = (pool >= 0).sum(axis=1) > width
        # Rows with room: the free places are at the end of each half.
        packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), axis=1)
        links[rows[~full]] = packed[~full, :width]
        for at in range(0, int(full.sum()), BATCH):
            part = np.flatnonzero(full)[at : at + BATCH]
            near = np.einsum("id,ijd->ij", points[rows[part]], points[np.maximum(pool[part], 0)])
            links[rows[part]] = diverse(points, *_sorted(pool[part], near, pool.shape[1]), width)


def descend(points: np.ndarray, layers: list[np.ndarray | None], queries: np.ndarray, above: int) -> np.ndarray:
    """For each query the nearest node found by walking down the layers above layer ``above``."""
    entry = np.zeros(len(queries), np.int64)
    for layer in range(len(layers) - 1, above, -1):
        entry = beam(points, layers[layer], queries, entry, EF_UPPER)[0][:, 0]
    return entry


def build(points: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of layers 0 to the top; ``level`` falls with the node's number."""
    n = len(points)
    layers: list[np.ndarray | None] = [None] * (int(level[0]) + 1 if n else 1)
    for layer in range(len(layers) - 1, -1, -1):
        size = int((level >= layer).sum())
        above = int((level >= layer + 1).sum())
        links = np.full((size, 2 * M if layer == 0 else M), -1, np.int32)
        lo = 0
        while lo < size:
            hi = min(size, lo + max(FIRST, min(lo, BATCH)))
            nodes, new = np.arange(lo, hi), points[lo:hi]
            mutual = new @ new.T
            np.fill_diagonal(mutual, -np.inf)
            few = min(CHOICE, len(nodes) - 1)
            place = np.argsort(-mutual, axis=1, kind="stable")[:, :few]
            ids, near = place + lo, np.take_along_axis(mutual, place, axis=1)
            if lo:
                entry = descend(points, layers, new, layer) if lo >= above else np.zeros(len(new), np.int64)
                old, old_near = beam(points, links[:lo], new, entry, EF_BUILD)
                ids, near = np.concatenate([old, ids], axis=1), np.concatenate([old_near, near], axis=1)
            chosen = diverse(points, *_sorted(ids, near, CHOICE), M) if ids.shape[1] else ids
            links[lo:hi, : chosen.shape[1]] = chosen
            _link_back(points, links, nodes, chosen)
            lo = hi
        layers[layer] = links
    return layers


def nearest(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, ef: int) -> np.ndarray:
    """Numbers of the ``ef`` nearest nodes found for each query (augmented by zero); a view as wide as the shard is the whole shard."""
    if ef >= len(points):
        return np.broadcast_to(np.arange(len(points)), (len(queries), len(points)))
    return beam(points, layers[0], queries, descend(points, layers, queries, 0), ef)[0]
