"""Token counts of whole texts for a tokenizer that cuts text into pre-tokens first.

Pieces are counted once per distinct pre-token of the corpus. Per-document pre-token frequencies are
joined to those counts and summed; no list of ids is ever made.

Defined results: a null text is empty and has no tokens; rows are independent, so repeated rows and
repeated or null ids give a row each; further columns of the input are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowledger.llm.term_sums import Numbering, postings, sum_over_terms

#: Letters whose class no Unicode version has changed, then ASCII punctuation without the apostrophe:
#: such a chunk is the word and the run of signs. Any other chunk goes to the library.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")
#: A space between two characters that aren't white space always starts a pre-token.
NOT_SIMPLE = re.compile(r"\s[\s ]|[\s ]\s")
CUT = re.compile(r"(?<=\S)(?= \S)")

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType())])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    """Cuts a chunk of text into the library's pre-tokens; special strings are pre-tokens of their own."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
            raise ValueError("counting by pre-token needs a pre-tokenizer and no normalizer")
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special strings that take in their surroundings aren't supported")
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in added) + ")") if added else None

    def __call__(self, chunk: str) -> list[str]:
        if m := PLAIN.fullmatch(chunk, chunk[:1] == " "):
            word = chunk[: m.end(1)]
            return [word, m[2]] if m[2] else [word]
        parts = self.special.split(chunk) if self.special else [chunk]
        return [t for i, part in enumerate(parts) for t in ([part] if i % 2 else self.pre_tokens(part))]

    def pre_tokens(self, text: str) -> list[str]:
        """The library names byte-level pre-tokens by stand-in letters; offsets give the text itself."""
        return [text[a:b] for _, (a, b) in self.cut(text)] if text else []


def chunks(text: str) -> Iterator[str]:
    """Pieces that no pre-token crosses; each but the first begins with its space."""
    if NOT_SIMPLE.search(text):
        return iter(CUT.split(text))
    first, *rest = text.split(" ")
    return chain([first], map(" ".__add__, rest))


def _reader(path: str):
    def read():
        numbering = Numbering(PreTokens(path))

        def parse(batch: pa.RecordBatch):
            texts = batch.column("text")
            sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            rows = pa.StructArray.from_arrays([batch.column("doc_id"), sizes], names=ROW.fieldNames())
            yield rows, ((map(numbering.__getitem__, chunks(t.as_py() or "")), n.as_py()) for t, n in zip(texts, sizes, strict=True))

        return parse, numbering

    return read


def _distinct(path: str):
    """The distinct pre-tokens of each run of documents."""

    def run(batches):
        cut, seen, done = PreTokens(path), set(), set()
        for batch in batches:
            for text in batch.column("text"):
                for chunk in chunks(text.as_py() or ""):
                    if chunk not in seen:
                        seen.add(chunk)
                        done.update(cut(chunk))
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string())], names=["term"])
                seen, done = set(), set()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string())], names=["term"])

    return run


def _piece_counts(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                terms = batch.column("term").slice(lo, 4096)
                counts = [len(e.ids) for e in tokenizer.encode_batch_fast(terms.to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([terms, pa.array(counts, pa.float64())], names=["term", "value"])

    return run


def pre_token_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of the texts and the number of its pieces: term, value."""
    distinct = docs.select(F.col(text).alias("text")).mapInArrow(_distinct(path), "term string").distinct()
    return distinct.mapInArrow(_piece_counts(path), "term string, value double")


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is the tokenizer's file, readable at the same place by every executor.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = postings(plain, _reader(path))
    summed = sum_over_terms(rows, pre_token_pieces(docs, path, text), ROW)
    n: Column = F.round("value_sum").cast("long")
    return summed.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
