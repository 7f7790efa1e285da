"""Sum, over each document, a value that is looked up per distinct term of the corpus.

Two operators need it: token counts (pieces per pre-token) and unigram scores (log-probability per
word). A plain (document, term, frequency) table is larger than the texts. Instead a task cuts its
documents into blocks and writes one row per (term, block): the positions, within the block, of the
documents that hold the term, each position repeated as often as the term occurs. Those rows are
joined to the term table, so a frequent term is one row per block and adaptive execution can split
it; partial sums per document are then added up by an ordinary aggregate.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block ends at so many documents (positions are 16-bit) or characters, whichever comes first.
BLOCK_ROWS = 32_768
BLOCK_CHARS = 32_000_000
#: Partial sums held by a task before they are handed on.
HELD_SUMS = 2_000_000

POSTINGS = "key string, block long, at binary"
#: ``place`` is empty where the sums are of all positions from 0; ``about`` holds a block's documents. Sums are packed:
#: most are small whole numbers, and there is one for each document in each task.
SUMS = "block long, place binary, value binary, hits binary, about binary"


class Numbering(dict):
    """Chunk of text -> numbers of its terms; terms are numbered as they are first met."""

    def __init__(self, expand: Callable[[object], Iterable[str]]):
        self.expand = expand
        self.terms: dict[str, int] = {}

    def __missing__(self, chunk):
        got = tuple(self.number(t) for t in self.expand(chunk))
        self[chunk] = got
        return got

    def number(self, term: str) -> int:
        return self.terms.setdefault(term, len(self.terms))


def _packed(rows: list[pa.StructArray]) -> bytes:
    """The documents of a block as an Arrow stream."""
    sink = pa.BufferOutputStream()
    batches = [pa.RecordBatch.from_struct_array(r) for r in rows]
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _postings(described: list[pa.StructArray], numbers: list[np.ndarray], terms: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """A row with the documents of a block, then a row per term."""
    names = ["key", "block", "at"]
    yield pa.RecordBatch.from_arrays([pa.array([f"d{block}"]), pa.array([block], pa.int64()), pa.array([_packed(described)], pa.binary())], names=names)
    flat = np.concatenate(numbers)
    order = np.argsort(flat, kind="stable")
    data = np.repeat(np.arange(len(numbers), dtype=np.uint16), [len(x) for x in numbers])[order].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(terms))) * 2])
    for lo in range(0, len(terms), 20_000):
        hi = min(lo + 20_000, len(terms))
        cut = (ends[lo : hi + 1] - ends[lo]).astype(np.int32)
        part = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data[ends[lo] : ends[hi]])])
        yield pa.RecordBatch.from_arrays([pa.array(["t" + t for t in terms[lo:hi]], pa.string()), pa.array(np.full(hi - lo, block), pa.int64()), part], names=names)


def postings(docs: DataFrame, read: Callable[[], tuple[Callable, Numbering]], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, block, at): key "d<block>" holds a block's documents, and "t<term>" the 16-bit positions
    in the block of the documents that hold the term.

    ``read()`` is called once per task. It gives a function and the numbering of terms. The function yields, for an
    Arrow batch, runs of its rows: (struct array that describes them; per row its term-number tuples and its characters). The order of rows within an input partition must not change when a task is
    repeated, which holds for file scans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        parse, numbering = read()
        described: list[pa.StructArray] = []
        numbers: list[np.ndarray] = []
        chars = 0

        def flush():
            nonlocal block, chars
            yield from _postings(described, numbers, list(numbering.terms), block)
            described.clear()
            numbers.clear()
            numbering.clear()
            numbering.terms.clear()
            block, chars = block + 1, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, each in parse(batch):
                start = 0
                for i, (tuples, size) in enumerate(each):
                    numbers.append(np.fromiter(chain.from_iterable(tuples), dtype=np.int32))
                    chars += size
                    if len(numbers) >= BLOCK_ROWS or chars >= block_chars:
                        described.append(rows.slice(start, i + 1 - start))
                        start = i + 1
                        yield from flush()
                if start < len(rows):
                    described.append(rows.slice(start))
        if numbers:
            yield from flush()

    return docs.mapInArrow(run, POSTINGS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the rows of a task, a row per block."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def row(block: int, place: bytes, value: bytes, hits: bytes, about: bytes | None):
        packed = (place, zlib.compress(value, 1), zlib.compress(hits, 1), about)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "place", "value", "hits", "about"])

    def hand_on():
        for block, (value, hits) in held.items():
            yield row(block, b"", value.tobytes(), hits.astype(np.uint32).tobytes(), None)
        held.clear()

    for batch in batches:
        at, value = batch.column("at"), batch.column("value")
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        is_doc = np.array(pc.starts_with(batch.column("key"), "d").to_numpy(zero_copy_only=False), dtype=bool)
        for i in np.flatnonzero(is_doc).tolist():
            yield row(int(blocks[i]), b"", b"", b"", at[i].as_py())
        found = ~is_doc & np.array(value.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        if not found.any():
            continue
        kept = at.take(pa.array(np.flatnonzero(found)))
        lengths = pc.binary_length(kept).to_numpy(zero_copy_only=False) // 2
        place = np.frombuffer(b"".join(kept.to_pylist()), dtype=np.uint16).astype(np.int64)
        worth = np.repeat(value.to_numpy(zero_copy_only=False)[found], lengths)
        own, nth = np.unique(blocks[found], return_inverse=True)
        width = int(place.max()) + 1
        cell = np.repeat(nth, lengths) * width + place
        if len(own) * width > HELD_SUMS:  # many blocks in one batch: only the cells that occur
            cells, of = np.unique(cell, return_inverse=True)
            value_sum, hit_sum = np.bincount(of, weights=worth), np.bincount(of)
            cuts = np.searchsorted(cells, np.arange(len(own) + 1) * width)
            for b, lo, hi in zip(own.tolist(), cuts, cuts[1:], strict=False):
                yield row(b, (cells[lo:hi] % width).astype(np.uint16).tobytes(), value_sum[lo:hi].tobytes(), hit_sum[lo:hi].astype(np.uint32).tobytes(), None)
            continue
        value_sum = np.bincount(cell, weights=worth, minlength=len(own) * width).reshape(len(own), width)
        hit_sum = np.bincount(cell, minlength=len(own) * width).reshape(len(own), width)
        for b, v, h in zip(own.tolist(), value_sum, hit_sum, strict=True):
            was = held.get(b)
            if was is None or len(was[0]) < width:
                held[b] = np.zeros(width), np.zeros(width, np.int64)
                size += width
                if was:
                    held[b][0][: len(was[0])], held[b][1][: len(was[1])] = was
                    size -= len(was[0])
            held[b][0][: len(v)] += v
            held[b][1][: len(h)] += h
        if size > HELD_SUMS:
            yield from hand_on()
            size = 0
    yield from hand_on()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block with their sums; the rows of a block follow one another."""
    value, hits, about, last = np.zeros(BLOCK_ROWS), np.zeros(BLOCK_ROWS, np.int64), b"", None

    def out():
        table = pa.ipc.open_stream(about).read_all().combine_chunks()
        n = table.num_rows
        for batch in table.append_column("value_sum", pa.array(value[:n])).append_column("hits", pa.array(hits[:n])).to_batches():
            yield batch
        value[:], hits[:] = 0, 0

    for batch in batches:
        for row in batch.to_pylist():
            if last is not None and row["block"] != last:
                yield from out()
            last = row["block"]
            if row["about"] is not None:
                about = row["about"]
                continue
            v, h = np.frombuffer(zlib.decompress(row["value"])), np.frombuffer(zlib.decompress(row["hits"]), dtype=np.uint32)
            at = np.frombuffer(row["place"], dtype=np.uint16) if row["place"] else slice(len(v))
            value[at] += v
            hits[at] += h
    if last is not None:
        yield from out()


def sum_over_terms(rows: DataFrame, values: DataFrame, row_type: T.StructType) -> DataFrame:
    """``rows`` of :func:`postings` with ``values`` (term string, value double), each term once.

    One row per document: the fields of ``row_type`` as its reader gave them, ``value_sum`` (sum of the value
    over all occurrences of terms that are in ``values``) and ``hits`` (how many occurrences those are).
    """
    looked_up = rows.join(values.select(F.concat(F.lit("t"), "term").alias("key"), "value"), "key", "left").select("key", "block", "at", "value")
    partial = looked_up.mapInArrow(_sums, SUMS).repartition("block").sortWithinPartitions("block")
    out = T.StructType([*row_type.fields, T.StructField("value_sum", T.DoubleType()), T.StructField("hits", T.LongType())])
    return partial.mapInArrow(_totals, out)
