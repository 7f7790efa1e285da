"""Groups of spelling variants: words one edit apart, found by a frontier of states that walks a relational trie.

1. Runs of Latin letters are taken from whole texts and counted as words.
2. Each word stands in two tries, one of the words and one of the reversed words, with an end mark. A trie is
   a distributed edge table: (node, label, words below), a node being the text of its prefix.
3. A state is (word, position, node, edits). Without an edit a state lies on its word's own path; there it
   branches to the sibling edges (a replaced letter) or skips a letter of its word (a deleted one). With an edit
   it follows equal labels only. Level by level all states are joined with the edges of the level.
4. A state whose node has a single word below is terminal: the pair is compared exactly, and stays if it is one
   edit apart. An inserted letter is a deleted one seen from the other word.

The edit of a pair lies in the first half of the word or in the second. The forward trie takes only edits in the
second half and the backward trie those in the first, so no state branches near the root, where nodes have
most edges and most words. A node has at most as many edges as there are letters, so a hot node only has many
states, and adaptive execution splits them. Each level is written, so a lost executor repeats part of one.

Words of more than LONG letters would need one level per letter. A pair with such a word is found by an equi-join
of hashes of the word without each of its letters, as many rows as letters, with the same exact comparison.

Defined results: a null text holds no words; a null id counts as an empty one; rows that repeat an id count each;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowledger.session import discard, materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences has a letter deleted, by the checksum of id and word.
DELETED = 31
#: Letters of the longest word that walks the trie.
LONG = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
END, FORWARD, BACKWARD = "$", ">", "<"
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """word, n: lower-cased runs of letters with their occurrences, of at least ``least`` letters."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), 0)).alias("run"),
    )
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    checked = low.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED == 0, shorter).otherwise(F.col("run"))
    return checked.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _letter(text: Column, depth: Column) -> Column:
    """The letter that follows ``depth`` letters; the direction's sign stands before them."""
    return text.substr(depth + 2, F.lit(1))


def trie_texts(vocabulary: DataFrame) -> DataFrame:
    """text, size, start: each word in both directions, and the depth from which its edits are looked for."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    forward = F.struct(F.concat(F.lit(FORWARD), "word", F.lit(END)).alias("text"), size.alias("size"), half.alias("start"))
    backward = F.struct(F.concat(F.lit(BACKWARD), F.reverse("word"), F.lit(END)).alias("text"), size.alias("size"), (size - half).alias("start"))
    return vocabulary.select(F.inline(F.array(forward, backward)))


def _level(texts: DataFrame, states: DataFrame | None, depth: int) -> DataFrame:
    """States after the edges of one level: text, position, node, below (words below the node), only (one of them)."""
    at = F.lit(depth)
    placed = texts.filter((F.col("start") <= depth) & (F.col("size") >= depth)).select(
        F.col("text").substr(1, depth + 1).alias("node"), "text", _letter(F.col("text"), at).alias("own"), _letter(F.col("text"), at + 1).alias("next")
    )
    edges = placed.groupBy("node", F.col("own").alias("label")).agg(F.count(F.lit(1)).alias("below"), F.min("text").alias("only"))
    replaced, deleted = F.col("label") > F.col("own"), (F.col("label") == F.col("next")) & (F.col("label") != F.col("own"))
    then = F.concat("node", "label").alias("node")
    # The end mark sorts before all letters, so it never replaces one.
    branched = placed.filter(F.col("own") != END).join(edges, "node").filter(replaced | deleted)
    out = branched.select("text", F.when(deleted, depth + 2).otherwise(depth + 1).alias("position"), then, "below", "only")
    # A letter may both replace the own one and be the next one: both states go on.
    both = branched.filter(replaced & deleted).select("text", F.lit(depth + 1).alias("position"), then, "below", "only")
    out = out.union(both)
    if states is not None:
        wanted = states.withColumn("label", _letter(F.col("text"), F.col("position")))
        out = out.union(wanted.join(edges, ["node", "label"]).select("text", F.col("position") + 1, then, "below", "only"))
    return out


def _pairs_in_tries(vocabulary: DataFrame) -> DataFrame:
    """a, b: words of at most LONG letters one edit apart."""
    short = vocabulary.filter(F.length("word") <= LONG)
    bounds = short.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    if bounds[0] is None:
        return vocabulary.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    texts = materialize(trie_texts(short.select("word")), "trie-texts")
    terminal, one_edit = F.col("below") == 1, F.levenshtein("text", "only", 1) == 1
    states, found = None, []
    for depth in range(bounds[0] // 2, bounds[1] + 1):
        step = materialize(_level(texts, states, depth).filter(~terminal | one_edit), "trie-level")
        found.append(step.filter(terminal).select("text", "only"))
        states = step.filter(~terminal).select("text", "position", "node")

    def word(text: str) -> Column:
        bare = F.col(text).substr(F.lit(2), F.length(text) - 2)
        return F.when(F.col(text).startswith(FORWARD), bare).otherwise(F.reverse(bare))

    return reduce(DataFrame.union, found).select(word("text").alias("a"), word("only").alias("b"))


def _without_each_letter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, at, word_id: of each word as a whole (at is -1) and without each of its letters."""
    inverse = pow(_BASE, -1, 1 << 64)
    for batch in batches:
        for word_id, word in zip(batch.column("word_id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            code = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
            power = np.full(len(code), _BASE, np.uint64)
            power[0] = 1
            part = code * np.multiply.accumulate(power)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            rest = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(inverse)
            hashes = np.concatenate([sums[-1:], rest]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(np.arange(-1, len(code)), pa.int32()), pa.array(np.full(len(hashes), word_id), pa.int64())], names=["hash", "at", "word_id"]
            )


def _pairs_of_long_words(vocabulary: DataFrame) -> DataFrame:
    """a, b: words one edit apart of which one has more than LONG letters."""
    long = materialize(vocabulary.filter(F.length("word") >= LONG).select("word", F.xxhash64("word").alias("word_id")), "long-words")
    hashes = materialize(long.mapInArrow(_without_each_letter, "hash long, at int, word_id long"), "long-variants")
    less, whole = hashes.filter("at >= 0"), hashes.filter("at < 0")
    replaced = less.toDF("hash", "at", "a_id").join(less.toDF("hash", "at", "b_id"), ["hash", "at"]).filter("a_id < b_id")
    deleted = less.toDF("hash", "at", "a_id").join(whole.select("hash", F.col("word_id").alias("b_id")), "hash")
    pairs = replaced.select("a_id", "b_id").union(deleted.select("a_id", "b_id")).distinct()
    named = pairs.join(long.toDF("a", "a_id"), "a_id").join(long.toDF("b", "b_id"), "b_id").select("a", "b")
    return named.filter((F.greatest(F.length("a"), F.length("b")) > LONG) & (F.levenshtein("a", "b", 1) == 1))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near: all pairs of words of the stored ``vocabulary`` (word) one edit apart, in both directions."""
    pairs = _pairs_in_tries(vocabulary).union(_pairs_of_long_words(vocabulary))
    return pairs.union(pairs.select("b", "a")).distinct().toDF("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: each word's form followed to the last, by pointers that double their reach."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "spelling-roots")
        moved = not then.filter("further is not null").isEmpty()
        discard(now)
        now = then.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    A word's form is its most frequent near word (the first in code-point order among equals), if that is at
    least ``ratio`` times as frequent as the word; its root is where its forms lead to.
    """
    vocabulary = materialize(words(docs, doc_id, text).filter(F.col("n") >= least_count), "spelling-words")
    near = near_words(vocabulary.select("word")).join(vocabulary.toDF("near", "near_n"), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near"))
    grouped = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    far = (-F.col("best.rank")) >= ratio * F.col("n")
    joined = vocabulary.join(grouped, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.rank")).alias("form_n")
    )
    table = materialize(joined, "spelling-forms")
    ends = roots(table.filter("form is not null"))
    return table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
