"""Near-duplicates of texts and vectors, components and the pipeline against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cases import SF, documents, key
from flowledger.llm import embedding_dedup, id_filter, minhash, queries, secret_scan
from flowledger.llm.components import connected_components
from flowledger.llm.words import WordHashes
from flowledger.session import materialize


def groups(pairs, nodes):
    """Least member of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 200), (300, 299), (300, 299), (299, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups(pairs, {n for p in pairs for n in p})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_listed_and_unlisted_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 50,) for i in range(200)] + [(None,)], "id int")
    ids = materialize(spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id long"), "test-ids")
    for words in (id_filter.WORDS, 1):
        monkeypatch.setattr(id_filter, "WORDS", words)  # with one word the bit set is full, and the join decides
        assert {r.id for r in id_filter.listed(rows, ids, "id").collect()} == set(range(0, 50, 3))
        assert id_filter.unlisted(rows, ids, "id").count() == 201 - 4 * 17
    none = ids.limit(0)
    assert id_filter.listed(rows, none, "id").count() == 0 and id_filter.unlisted(rows, none, "id").count() == 201


# -- texts -------------------------------------------------------------------------------------------


def plain_groups(rows):
    """Exact groups of (id, text) rows by weighted Jaccard similarity of all pairs that share a shingle."""
    hashes = WordHashes()
    words = [(i, hashes.of(t or "")) for i, t in rows]
    frequency = np.zeros(minhash.WIDTH + 1, np.int64)
    for _, w in words:
        frequency[np.unique(w & np.uint64(minhash.WIDTH - 1)).astype(int)] += 1
        frequency[-1] += len(w) > 0
    idf = minhash.inverse(frequency)
    vectors = [(i, minhash.weights(w, idf)) for i, w in words if i is not None and len(w)]
    holders = defaultdict(list)
    for n, (_, v) in enumerate(vectors):
        for s in v[0].tolist():
            holders[s].append(n)
    shared = Counter((a, b) for held in holders.values() for i, b in enumerate(held) for a in held[:i])
    pairs = [(vectors[a][0], vectors[b][0]) for a, b in shared if minhash.similarity(vectors[a][1], vectors[b][1]) >= minhash.THRESHOLD]
    return groups(pairs, {i for i, _ in rows if i is not None})


def near_copies(spark, n=30):
    """One text, and copies of it that each differ in a word of their own, so that copies differ more from one another."""
    base = [f"word{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(base[: 3 * i] + [f"other{i}"] + base[3 * i + 1 :])) for i in range(1, n)]
    rows.append((5000, " ".join(base)))
    rows += [(6000 + i, " ".join(f"new{i}x{j}" for j in range(100)) + " " + " ".join(base[:60])) for i in range(10)]
    return documents(spark, rows)


@pytest.mark.parametrize("source", ["documents", "copies"])
def test_text_groups_equal_brute_force(spark, source):
    docs = documents(spark) if source == "documents" else near_copies(spark)
    got = minhash.near_duplicates(docs).collect()
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((key(r.doc_id), key(r.class_id), r.kept) for r in got) == sorted(
        (key(r.doc_id), key(want.get(r.doc_id)), r.doc_id is None or want[r.doc_id] == r.doc_id) for r in docs.collect()
    )


def test_classes_that_different_leaders_reached_are_compared(spark):
    """A chain H1-B-C-H2 of which only neighbours are similar; both ends lead before B and C."""
    chain = lambda at: " ".join(f"word{i}" for i in range(8 * at, 8 * at + 100))
    other = lambda name: " ".join(f"{name}{i}" for i in range(100))
    texts = {1: other("z"), 2: chain(0), 3: chain(3), 4: other("y"), 5: other("x"), 6: chain(1), 7: chain(2)}
    leads = spark.createDataFrame([(n, [1, 2], bytes(2 * minhash.SAMPLES)) for n in texts], "node long, bands array<long>, samples binary")
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = [(r.a, r.b) for r in minhash.links(rows, leads, np.ones(minhash.WIDTH)).collect()]
    assert groups(found, texts) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 2, 7: 2}


def test_deduplicate_leaves_one_of_each_group(spark):
    docs = documents(spark)
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted([key(g) for g in set(want.values())] + ["null", "null"])
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng, sample = np.random.default_rng(0), minhash.Sampler()
    hits, total = 0, 0
    for _ in range(60):
        found = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        weight = rng.random(len(found)) * 5 + 0.1
        other = weight * np.where(rng.random(len(found)) < 0.3, 0.3, 1.0)
        want = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
        hits += (sample(found, weight) == sample(found, other)).mean() - want
        total += 1
    assert abs(hits / total) < 0.02


# -- vectors -----------------------------------------------------------------------------------------

BAD = [(-1, None, 1), (-2, [0.0, 0.0], 1), (-3, [1.0, 0.0], None), (-7, [float("nan"), 1.0], 1), (-8, [float("inf"), 1.0], 1), (-9, [1.0, None], 1), (-10, [], 1), (None, [1.0, 2.0], 1)]
GOOD = [(-4, [1.0, 2.0], 1), (-5, [2.0, 4.0], 1), (-6, [1.0, 2.0], 1), (-6, [1.0, 2.0], 1), (-11, [1.0, 2.0], 2), (-12, [1.0, 2.0, 0.0], 1), (-13, [1e-30, 2e-30], 1), (-14, [3e38, 3e38], 3), (-15, [3e38, 3e38], 3)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS u", "3 AS size")


def brute_vectors(rows):
    x = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x[n] = (np.array(v, np.float32).astype(float), label)
    unit = {n: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for n, (v, _) in x.items()}
    pairs = [(a, b) for a in x for b in x if a < b and x[a][1] == x[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= embedding_dedup.THRESHOLD]
    degree = Counter(n for p in pairs for n in p)
    part = groups([(rows[a][0], rows[b][0]) for a, b in pairs], {r[0] for r in rows if r[0] is not None})
    return sorted((key(i), degree[n], key(part.get(i)), i is None or part[i] == i) for n, (i, _, _) in enumerate(rows))


def test_vector_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = BAD + GOOD
    for i in range(40):
        rows.append((i, rng.normal(size=16).tolist(), int(i % 3)))
    for label, size in ((0, 90), (1, 3), (2, 25)):  # dense groups larger than any list, and a chain
        centre = rng.normal(size=16)
        rows += [(len(rows) * 10 + j, (centre + rng.normal(size=16) * 0.15).tolist(), label) for j in range(size)]
    angles = np.arange(30) * 0.3
    rows += [(9000 + i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14, 4) for i, a in enumerate(angles)]
    table = vectors(spark, rows)
    got = sorted((key(r.vec_id), r.n_links, key(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == brute_vectors([(r.vec_id, r.embedding, r.label) for r in table.collect()])
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_a_weak_link_between_dense_groups(spark):
    """Two groups of near copies fill their members' lists with each other; one pair of 0.94 joins the groups."""
    draw = np.random.default_rng(5)
    first, second = np.linalg.qr(draw.normal(size=(32, 2)))[0].T
    near = lambda c: c + draw.normal(size=(200, 32)) * 0.012
    # u and v lean towards each other; all others are further from the other group
    angle = np.arccos(0.86)
    second = first * np.cos(angle) + second * np.sin(angle)
    u, v = first * 0.8 + second * 0.2, second * 0.8 + first * 0.2
    x = np.concatenate([near(first), near(second), [u, v]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(linked, False)
    across = linked.copy()
    side = np.array([0] * 200 + [1] * 200 + [0, 1])
    across[side[:, None] == side[None, :]] = False
    assert across[400, 401] and across.sum() == 2
    table = spark.createDataFrame([(i, "a", e.tolist()) for i, e in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert {r.component_id for r in got.values()} == {0}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()


def test_recall_is_measured(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    table = vectors(spark, [(i, (centre + rng.normal(size=8) * 0.1).tolist(), 1) for i in range(60)])
    nodes = materialize(embedding_dedup.classes(table.filter(embedding_dedup.usable())), "test-nodes")
    parts = embedding_dedup.connected(nodes)
    found, there = embedding_dedup.audit_recall(parts, nodes)
    assert there > 1000 and found >= 0.9 * there
    assert embedding_dedup.audit_recall(parts.limit(0), nodes) == (0, there)
    half = parts.selectExpr("node", "node % 2 AS component")
    assert 0 < embedding_dedup.audit_recall(half, nodes)[0] < there


def test_runs_are_cut_at_keys_and_length():
    batch = pa.RecordBatch.from_pydict({"k": [1] * 7 + [2] * 3 + [3] * 2})
    parts = [batch.slice(0, 4), batch.slice(4, 5), batch.slice(9, 3)]
    assert [t.column("k").to_pylist() for t in embedding_dedup._cut(iter(parts), ["k"], 4)] == [[1] * 4, [1] * 3, [2] * 3, [3] * 2]
    assert [t.num_rows for t in embedding_dedup._groups(iter(parts), ["k"])] == [7, 3, 2]


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]  # every language here is known, so only texts without letters go
    part = plain_groups(rows)
    rows = [(i, t) for i, t in rows if part[i] == i]
    items = [re.findall(r"[^\W\d_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingle = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = [shingle(w) for w in items]
    leaking = {i for i, t in rows for w in wanted if w and len(w & shingle(re.findall(r"[^\W\d_]+", t.lower()))) >= 0.8 * len(w)}
    patterns = [(re.compile(r.pattern, re.A), r.group, r.least) for r in secret_scan.RULES]

    def clean(text):
        marks = sorted((m.start(), m.end()) for p, g, n in patterns for m in p.finditer(text) if len(m[g]) >= n)
        out, at = "", 0
        for a, b in marks:
            if a > at or not at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    want = sorted((i, library.encode(clean(t))) for i, t in rows if i not in leaking)
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(leaking) > 0


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
