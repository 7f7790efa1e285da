"""Whitening, nearest neighbours and spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF
from flowledger.llm import nearest, queries, small_world, spectrum, spelling, whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, dim int, rank int, score double, `key` string"


def vectors(spark, rows):
    """Rows (vec_id, embedding) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, e, 1, 2, 3, 4, 0.5, "k") for i, e in rows], VECTORS)


ODD = [
    (900, None), (901, []), (902, [float("nan"), 1.0, 2.0]), (903, [float("inf"), 0.0, 1.0]), (904, [None, 1.0, 1.0]),
    (906, [1.0, 2.0]), (907, [3.0, -1.0]), (908, [0.5, 0.25]),
]


def random_rows(seed, n=60, dim=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.array([3.0, 1.0, 0.3])[:dim]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


# -- spectrum and whitening -----------------------------------------------------------------------


def polynomial(matrix):
    primes = spectrum.moduli(spectrum.coefficient_bound(matrix))
    return spectrum.remainders_joined([spectrum.characteristic_modulo(matrix, p) for p in primes], primes)


def test_characteristic_polynomial_is_exact():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 9):
        a = rng.integers(-9, 9, (d + 2, d))
        m = (a.T @ a).tolist()
        # Faddeev-LeVerrier in whole numbers
        identity, power, want = np.eye(d, dtype=object), np.eye(d, dtype=object), [1]
        for k in range(1, d + 1):
            product = np.array(m, dtype=object).dot(power)
            want.append(-(sum(product[i, i] for i in range(d)) // k))
            power = product + want[-1] * identity
        assert polynomial(m) == want[::-1]


def test_roots_and_spaces_with_multiplicity():
    turn = [[2, 1, 0, 0], [-1, 2, 0, 0], [0, 0, 1, 2], [0, 0, -2, 1]]  # orthogonal up to a factor of 5
    for values in ([7, 7, 7, 2], [5, 5, 3, 3], [4, 3, 0, 0], [0, 0, 0, 0], [10**20, 10**20 + 1, 1, 0]):
        t = np.array(turn, dtype=object)
        m = t.T.dot(np.diag(np.array(values, dtype=object))).dot(t)
        roots, shift = spectrum.largest_roots(polynomial(m.tolist()), 4)
        found = [root / 2**shift for root, times in roots for _ in range(times)]
        assert found == pytest.approx(sorted((5.0 * v for v in values if v), reverse=True), rel=1e-30)
        for root, times in roots:
            space = np.array(spectrum.null_vectors(m.tolist(), root, shift, times))
            assert np.abs(space @ space.T - np.eye(times)).max() < 1e-14
            assert np.abs(m.astype(float) @ space.T - root / 2**shift * space.T).max() <= 1e-14 * max(found)


def expected_whitening(rows, many=8):
    x = np.floor(np.array([e for _, e in rows]) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:many], vector[:, ::-1][:, :many]
    return ((n * x - sums) ** 2).sum(axis=1), centred @ vector / np.sqrt(value), value / np.trace(centred.T @ centred / n)


def check_whitening(got, rows):
    deviation, white, share = expected_whitening(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == white.size
    for c in range(white.shape[1]):
        own = np.array([by[i, c + 1].whitened for i, _ in rows])
        sign = np.sign(own @ white[:, c])
        assert np.abs(own * sign - white[:, c]).max() < 1e-9
        assert all(by[i, c + 1].explained == pytest.approx(share[c], rel=1e-9) for i, _ in rows)
    assert [int(by[i, 1].deviation) for i, _ in rows] == deviation.tolist()
    assert all(r.n == len(rows) and r.identity_error < 1e-9 for r in got)


def test_whitening_against_brute_force(spark):
    rows = random_rows(1)
    got = whitening.whiten(vectors(spark, rows + ODD)).collect()
    check_whitening([r for r in got if r.vec_id < 900], rows)
    check_whitening([r for r in got if r.vec_id >= 900], ODD[-3:])


def test_registered_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op11(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check_whitening(got.collect(), [(r.vec_id, r.embedding) for r in table])


def test_whitening_without_variance_ties_and_empty(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 3 for r in same)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {(r.component, r.explained) for r in line} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in line)
    ties = whitening.whiten(vectors(spark, [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])).collect()
    assert all(r.explained == 0.5 and r.identity_error < 1e-12 for r in ties)
    assert whitening.whiten(vectors(spark, [])).count() == 0
    large = whitening.whiten(vectors(spark, [(0, [1e14, 1.0]), (1, [-3e14, 2.0]), (2, [1e300, 1.0])])).collect()
    assert {r.vec_id for r in large} == {0, 1} and all(r.n == 2 for r in large)
    x = [int(1e14 * 1024), int(-3e14 * 1024)]
    assert {int(r.deviation) for r in large} == {(x[0] - x[1]) ** 2 + 1024**2}


# -- nearest neighbours ---------------------------------------------------------------------------


def expected_neighbours(rows, k=20):
    good = sorted({(i, tuple(e)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)})
    out = set()
    for q, e in good:
        if q % 20 == 0:
            others = sorted((-float((np.array(e) * np.array(f)).sum()), i) for i, f in good if i != q and len(f) == len(e))
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(others[:k])}
    return out


def test_neighbours_of_odd_rows_copies_and_ties(spark):
    rows = random_rows(3, 70) + ODD + [(905, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(1000 + i, [2.0, 0.5, 0.1]) for i in range(60)] + [(1020, [2.0, 0.5, 0.1]), (1040, [9.0, 9.0, 9.0])]
    got = nearest.search(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == expected_neighbours(rows)
    assert nearest.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.search(vectors(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_small_shards_reach_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1)))]
    frame = vectors(spark, rows).repartition(3)
    monkeypatch.setattr(nearest, "SHARD_VALUES", 16 * 400)
    monkeypatch.setattr(nearest, "BLOCK_VALUES", 16 * 70)
    monkeypatch.setattr(nearest, "EF", 24)
    got = {tuple(r) for r in nearest.search(frame, F.col("vec_id") % 20 == 0).collect()}
    want = expected_neighbours(rows)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.95 * len(want)
    scores = {(q, v): s for q, _, v, s in want}
    assert all(scores[q, v] == s for q, _, v, s in got if (q, v) in scores)


def test_graph_layers_are_linked_and_bounded():
    rng = np.random.default_rng(0)
    points = small_world.augmented(rng.normal(size=(900, 8)))
    level = small_world.levels(len(points), 3)
    layers = small_world.build(points, level)
    assert [len(x) for x in layers] == [(level >= i).sum() for i in range(len(layers))]
    assert all(x.shape[1] == (2 * small_world.M if i == 0 else small_world.M) and (x < len(x)).all() for i, x in enumerate(layers))
    norms = (points.astype(float) ** 2).sum(axis=1)
    assert np.abs(norms - 1).max() < 1e-5
    seen, front = {0}, [0]
    while front:
        for v in layers[0][front.pop()].tolist():
            if v >= 0 and v not in seen:
                seen.add(v)
                front.append(v)
    assert len(seen) == len(points)


# -- spelling variants ----------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def expected_variants(rows):
    n = plain_words(rows)
    rest, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest[i, w[:i] + w[i + 1 :]].add(w)
    for (_, less), some in rest.items():
        for a in some:
            near[a] |= some - {a}
            if less in n:
                near[a].add(less)
                near[less].add(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, n long, `only` int")
    got = [tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_variants_of_odd_texts(spark):
    words = "garden gardens gardenss gaarden garden's Gardening gardenin aaaaaaa aaaaaaaa aaaaaaaaa éàüößéàü éàüößéàu straße×÷ strasse ab"
    rows = [(None, words), (None, None), (1, None), (2, ""), (3, words.upper()), (3, words), (4, words * 30), (15, "gardenings " * 300), (6, "gardening " * 4000), (7, "gardeningg gardeningss " * 3)]
    long = "".join(chr(97 + i * i % 26) for i in range(400))
    rows += [(8, " ".join([long, long[:200] + long[201:], long[:64], long[:65], long[:66], long[:63], long[:30] + "q" + long[31:65], long[:5] + "z" + long[6:]] * 3))]
    rows += [(9, " ".join([("b" * i + " ") * 2 for i in range(60, 72)]))]
    got = variants(spark, rows)
    assert got == expected_variants(rows)
    assert any(len(w) > 300 and near for w, _, near, *_ in got) and any(form and root != form for *_, form, _, root in got)


def test_spelling_variants_of_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert variants(spark, rows) == expected_variants(rows)


def test_no_words(spark):
    assert variants(spark, []) == set() and variants(spark, [(1, "short words only"), (2, None)]) == set()
