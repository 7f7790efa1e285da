"""Near-duplicate texts by improved consistent weighted sampling.

1. The document frequency of words is counted over all documents, in a table of fixed width as in feature
   hashing. A shingle of five words weighs its frequency in the text times the mean inverse document
   frequency of its words.
2. Each text gets ``BANDS`` x ``ROWS`` samples: two texts share a sample with the probability of their weighted
   Jaccard similarity. Texts with equal words form a class, of which one document takes part further.
3. Classes that agree in two bands meet in a bucket. In each bucket the most connected classes lead: those of
   other groups are compared with them, first by samples and then exactly. What a leader reached is linked and leads
   after those that none reached; a bucket has four times the leaders each round, until what has not led is one
   group. So each pair of a bucket is compared, but for those that links already connect.
4. Links give the groups.

Defined results: a null text, or one without words, is alone; fewer than five words are one shingle; a row
without id is alone; rows that share an id are one document, all of whose texts link; repeated rows give a
row each; further columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.components import connected_components
from flowledger.llm.id_filter import listed, unlisted
from flowledger.llm.memory import tidy
from flowledger.llm.words import SHINGLE, WordHashes, mix, shingles
from flowledger.session import discard, materialize

THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Pairs whose samples agree less often aren't compared exactly: at the threshold that is 3.6 standard deviations away.
LEAST_AGREEMENT = 40
#: In each round a bucket has so many times more leaders, so the rounds grow with the logarithm of its classes.
LEADERS_GROW = 4
#: Width of the table of document frequencies.
WIDTH = 1 << 18
#: Random triples the samples draw on; a multiply-shift hash per sample picks one for each shingle.
POOL_BITS = 14

SKETCH = "doc_id long, key1 long, key2 long, bands array<long>, samples binary"


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts hold a word of each hash slot; the last entry is the number of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(WIDTH + 1, np.int64), WordHashes()
        for batch in batches:
            for text in batch.column("text"):
                slots = np.unique(hashes.of(text.as_py()) & np.uint64(WIDTH - 1)).astype(np.int64)
                counts[slots] += 1
                counts[WIDTH] += len(slots) > 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["slot", "n"])

    out = np.zeros(WIDTH + 1, np.int64)
    got = docs.select("text").mapInArrow(tidy(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def inverse(frequencies: np.ndarray) -> np.ndarray:
    return np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1


def weights(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their weights."""
    each = idf[(words & np.uint64(WIDTH - 1)).astype(np.int64)]
    size = min(SHINGLE, len(words))
    mean = np.zeros(len(words) - size + 1)
    for i in range(size):
        mean += each[i : len(mean) + i]
    found, first, times = np.unique(shingles(words), return_index=True, return_counts=True)
    return found, times * mean[first] / max(size, 1)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


class Sampler:
    """Improved consistent weighted samples: per sample the shingle, and the step of its weight, that win."""

    def __init__(self):
        rng = np.random.default_rng(20100514)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.beta = rng.random(size, dtype=np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.inverse_r = 1 / self.r
        self.offset = self.log_c - self.r
        self.factors = (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def __call__(self, found: np.ndarray, weight: np.ndarray) -> np.ndarray:
        log_w = np.log(weight).astype(np.float32)
        chosen, steps = np.empty(SAMPLES, np.intp), np.empty(SAMPLES, np.float32)
        for lo in range(0, SAMPLES, 8):
            at = ((found[None, :] * self.factors[lo : lo + 8, None]) >> np.uint64(64 - POOL_BITS)).astype(np.intp)
            step = self.inverse_r[at]
            step *= log_w
            value = self.beta[at]
            step += value
            np.floor(step, out=step)
            value -= step
            value *= self.r[at]
            value += self.offset[at]  # log c - r (step - beta + 1)
            best = chosen[lo : lo + 8] = value.argmin(axis=1)
            steps[lo : lo + 8] = step[np.arange(8), best]
        return mix(found[chosen] ^ mix(steps.astype(np.int64).view(np.uint64), 1), 2)


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, the hash of the words, the keys of the bands and 16 bits of each sample; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, sample = WordHashes(), Sampler()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = hashes.of(text.as_py())
                if not len(words):
                    continue
                drawn = sample(*weights(words, idf))
                bands = drawn.reshape(BANDS, ROWS)
                key = np.zeros(BANDS, np.uint64)
                for i in range(ROWS):
                    key = mix(key ^ bands[:, i], i)
                one, two = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), dtype=np.int64).tolist()
                rows.append((doc_id, one, two, key.view(np.int64), (drawn & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
            if rows:
                ids, one, two, keys, samples = zip(*rows, strict=True)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))), pa.array(samples, pa.binary())],
                    names=["doc_id", "key1", "key2", "bands", "samples"],
                )

    return docs.mapInArrow(tidy(run), SKETCH)


def buckets(leads: DataFrame) -> DataFrame:
    """bucket, node: classes that agree in two bands; buckets of one class are left out."""
    band = leads.select("node", F.posexplode("bands").alias("band", "key"))
    met = band.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    shared = band.join(met, ["band", "key"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("band", "key"))).alias("keys"))
    paired = shared.select(
        "node",
        F.explode(
            F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x["band"], x["key"], y["band"], y["key"]))))
        ).alias("bucket"),
    )
    several = paired.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return paired.join(several, "bucket").select("bucket", "node", "members")


def compare(pairs: DataFrame, samples: DataFrame, texts: DataFrame, idf: np.ndarray, least: int = LEAST_AGREEMENT) -> DataFrame:
    """leader, node, sim of the pairs whose samples agree often enough; ``texts``: node, text."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SAMPLES) for c in ("own", "samples"))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select(["leader", "node"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = WordHashes(), None, None
        for batch in batches:
            sims = []
            for leader, text, other in zip(batch.column("leader").to_pylist(), batch.column("own"), batch.column("text"), strict=True):
                if leader != last:
                    last, own = leader, weights(hashes.of(text.as_py()), idf)
                sims.append(similarity(own, weights(hashes.of(other.as_py()), idf)))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node"), pa.array(sims, pa.float64())], names=["leader", "node", "sim"])

    own = lambda t, c: t.select(F.col("node").alias("leader"), F.col(c).alias("own"))
    likely = pairs.join(samples, "node").join(own(samples, "samples"), "leader").mapInArrow(tidy(agree), "leader long, node long")
    return likely.join(texts, "node").join(own(texts, "text"), "leader").select("leader", "own", "node", "text").mapInArrow(tidy(exact), "leader long, node long, sim double")


def links(rows: DataFrame, leads: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: linked classes, enough to connect every group."""
    spark = rows.sparkSession
    open_ = materialize(buckets(leads), "buckets")
    rank = open_.groupBy("node").agg(F.sum("members").alias("weight"))
    now = materialize(open_.select("bucket", "node").join(rank, "node").withColumns({"reached": F.lit(False), "label": F.col("node")}), "buckets")
    discard(open_)
    nodes = materialize(now.select("node").distinct(), "bucket-nodes")
    samples = materialize(leads.join(nodes, "node", "left_semi").select("node", "samples"), "bucket-samples")
    texts = materialize(
        listed(rows.select(F.col("doc_id").alias("node"), "text"), nodes, "node").groupBy("node").agg(F.max("text").alias("text"))
        if _repeated(rows)
        else listed(rows.select(F.col("doc_id").alias("node"), "text"), nodes, "node"),
        "bucket-texts",
    )
    found = [spark.createDataFrame([], "leader long, node long, sim double")]
    leading = 1
    while not now.isEmpty():
        order = Window.partitionBy("bucket").orderBy("reached", F.desc("weight"), "node")
        leaders = now.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= leading).select("bucket", F.col("node").alias("leader"), F.col("label").alias("leads"))
        leaders = materialize(leaders, "leaders")
        pairs = now.join(leaders, "bucket").filter("leads <> label").select("leader", "node").distinct()
        sims = materialize(compare(pairs, samples, texts, idf).filter(F.col("sim") >= threshold), "similar")
        found.append(sims)
        # what has led met all of its bucket and is done; what a leader of its bucket reached leads later
        led = leaders.select("bucket", F.col("leader").alias("node"))
        hits = leaders.join(sims, "leader").select("bucket", "node").distinct().withColumn("hit", F.lit(True))
        rest = now.drop("label").join(led, ["bucket", "node"], "left_anti").join(hits, ["bucket", "node"], "left")
        rest = rest.select("bucket", "node", "weight", (F.col("reached") | F.col("hit").isNotNull()).alias("reached"))
        # classes that links so far connect need no comparison, so a bucket is done when the rest of it is one group
        group = connected_components(_union(found).select(F.col("leader").alias("a"), F.col("node").alias("b")))
        rest = rest.join(materialize(group.toDF("node", "label"), "groups"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        state = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        then = materialize(rest.join(state.filter("low <> high").select("bucket"), "bucket", "left_semi"), "buckets")
        discard(now)
        now, leading = then, leading * LEADERS_GROW
    return _union(found).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.union(more)
    return every


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the group) and kept (it is that document)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    idf = inverse(document_frequencies(rows))
    drawn = materialize(sketches(rows.filter(F.col("doc_id").isNotNull()), idf), "sketches")
    classes = drawn.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    member = materialize(drawn.select("doc_id", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "node").distinct(), "copies")
    leads = drawn.join(member.filter("doc_id = node").select("node"), drawn["doc_id"] == F.col("node"), "left_semi").withColumnRenamed("doc_id", "node").dropDuplicates(["node"])
    linked = links(rows, leads, idf, threshold)
    copies = member.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = materialize(connected_components(linked.union(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "near-duplicate-groups")
    ids = rows.select("doc_id").join(parts, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return ids.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; repeated rows of it go too."""
    decided = materialize(near_duplicates(docs, doc_id, text, threshold), "near-duplicates")
    gone = materialize(decided.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct(), "removed")
    stays = unlisted(docs, gone, doc_id)
    again = materialize(decided.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id), "repeated")
    return unlisted(stays, again, doc_id).unionByName(listed(stays, again, doc_id).dropDuplicates([doc_id]))
