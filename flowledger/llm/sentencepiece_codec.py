"""Encode and decode with a SentencePiece model file, on the tokenizers library as backend.

The model file is read as protobuf wire data; from it the normaliser, the metaspace marker, the scores
and the byte fallback are rebuilt. A unigram model becomes the backend's unigram model. A BPE model has
scores that are merge ranks, so its merges are rebuilt from them. Batches of distinct words are encoded
with the backend's threads. Every whole text is also encoded by the SentencePiece library, and has ``parity``
when the ids agree.

Words can be encoded apart when no piece of the vocabulary holds the marker after another character,
which is checked; otherwise whole texts are. A BPE backend takes many words as one input, between them a character
that no piece holds, so no merge reaches from one to the next. Defined results: a null text is empty and has no ids; rows
are independent, so repeated rows, repeated or null ids and ties need nothing; a text that holds the
marker itself decodes to a space, so it has no ``round_trip``; further columns are ignored; an empty
table gives an empty result. No text is truncated.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm.memory import tidy

MARK = "▁"
#: Bytes of words and ids, and of the objects that hold them, that a task remembers before it starts anew.
REMEMBERED, ENTRY = 32_000_000, 150
#: Words of an input, inputs that the backend takes at once, its threads in a task, and characters of the texts encoded together.
TOGETHER, AT_ONCE, THREADS, SLICE = 200, 40, 2, 400_000
#: Stands between the words of an input. Words that hold it are encoded without.
BETWEEN = "\U0010ffff"

WORD_AND_SIGNS = re.compile(r"(\w+)([^\w\0]+)")

# Fixed values of the model format: field numbers, model and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    whitespace_as_suffix: bool
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def by_word(self) -> bool:
        """No piece holds the marker after another character."""
        normal = (p for p, _, kind in self.pieces if kind in (NORMAL, USER))
        return self.escape and not self.whitespace_as_suffix and not any(MARK in p.lstrip(MARK) for p in normal)


def parse_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == PIECES:
            got = dict(fields(value))
            pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    return Model(
        pieces,
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        bool(trainer.get(24, 0)),
        normalizer.get(2, b""),
        bool(normalizer.get(3, 1)),
        bool(normalizer.get(4, 1)),
        bool(normalizer.get(5, 1)),
    )


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best score of the result first, then as long a left part as can be."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = [(-score[p], i, -cut, p[:cut], p[cut:]) for i, p in enumerate(score) for cut in range(1, len(p)) if p[:cut] in score and p[cut:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def normalizers(model: Model) -> list:
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and not model.whitespace_as_suffix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return steps


def backend(model: Model, between: str = ""):
    """A tokenizer without normaliser or special tokens; it takes normalised text. ``between`` gets the id after the last."""
    from tokenizers import Tokenizer, models

    if model.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback))
    if model.kind != BPE:
        raise ValueError("only unigram and BPE models can be rebuilt")
    vocab = {p: i for i, p in enumerate([*(p for p, _, _ in model.pieces), *between])}
    # the backend's own memory of words would only hold whole inputs, which don't come again
    cache = {"cache_capacity": 0} if between else {}
    return Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, **cache))


class Codec:
    """Encoder and decoder of one task, with the ids of words met before."""

    def __init__(self, path: str, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # the backend's threads; each holds memory of its own
        with open(path, "rb") as file:  # a vocabulary file installed with the executors, not an input
            self.model = parse_model(file.read())
        #: Whether words can be told apart again in the ids of an input.
        self.together = self.model.kind == BPE and not any(BETWEEN in p for p, _, _ in self.model.pieces)
        self.tokenizer = backend(self.model, BETWEEN if self.together else "")
        self.steps = normalizers(self.model)
        self.by_word = self.model.by_word
        self.simple = len(self.steps) == 2 and self.model.dummy_prefix and self.by_word and not self.model.charsmap and not self.model.remove_extra
        #: Ids as bytes, which takes a fraction of the memory and joins at once; and those of the generation before.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0
        self.plain = None
        self.kind = "H" if len(self.model.pieces) < 1 << 16 else "I"
        self.check = None
        if verify:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Characters that stand side by side in some piece; between any others no merge can reach.
        self.joined = {p[i : i + 2] for p, _, kind in self.model.pieces if kind in (NORMAL, USER) for i in range(len(p) - 1)}
        self.surface = pa.array([self._bytes(p, kind) for p, _, kind in self.model.pieces], pa.binary())

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(MARK, " ")).encode()

    def normalise(self, text: str) -> str:
        for step in self.steps:
            text = step.normalize_str(text)
        return text

    def words(self, text: str) -> list[str]:
        """Parts of the normalised text that are encoded apart, each without its first marker, or as it is after a NUL."""
        if self.simple and "  " not in text and MARK not in text and text[:1] != " " and "\0" not in text:
            return text.split(" ") if text else []
        whole = self.normalise(text)
        if not whole:
            return []
        if not self.by_word:
            return [whole]
        return [w[1:] if w[0] == MARK and w[1:2] != "\0" else "\0" + w for w in re.findall(f"{MARK}+[^{MARK}]*|^[^{MARK}]+", whole)]

    def _whole(self, word: str) -> str:
        return word if not self.by_word else word[1:] if word[:1] == "\0" else MARK + word

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet, in batches over the backend's threads."""
        if self.size > REMEMBERED:
            self.known, self.before, self.size = {}, self.known, 0
        new = words.difference(self.known)
        if self.before:
            again = {w: ids for w in new if (ids := self.before.get(w)) is not None}
            self._remember(again)
            new.difference_update(again)
        whole, split = set(), {}
        for word in new:
            if not word.isalnum() and self.by_word and (m := WORD_AND_SIGNS.fullmatch(word)):
                letters, signs = m.groups()
                if letters[-1] + signs[0] not in self.joined:
                    split[word] = (letters, "\0" + signs)
                    whole.update(split[word])
                    continue
            whole.add(word)
        whole.difference_update(self.known)
        odd = [w for w in whole if BETWEEN in w] if self.together else list(whole)
        self._encode_apart(self._plain() if self.together and odd else self.tokenizer, odd)
        if self.together:
            self._encode_together(list(whole.difference(odd)))
        self._remember({word: self.known[a] + self.known[b] for word, (a, b) in split.items()})

    def _plain(self):
        if self.plain is None:
            self.plain = backend(self.model)
        return self.plain

    def _encode_apart(self, tokenizer, words: list[str]) -> None:
        for lo in range(0, len(words), TOGETHER * AT_ONCE):
            some = words[lo : lo + TOGETHER * AT_ONCE]
            encoded = tokenizer.encode_batch_fast(list(map(self._whole, some)), add_special_tokens=False)
            self._remember({w: array(self.kind, e.ids).tobytes() for w, e in zip(some, encoded, strict=True)})

    def _encode_together(self, words: list[str]) -> None:
        cut, width = len(self.model.pieces), array(self.kind).itemsize
        for lo in range(0, len(words), TOGETHER * AT_ONCE):
            some = words[lo : lo + TOGETHER * AT_ONCE]
            inputs = [BETWEEN.join(map(self._whole, some[i : i + TOGETHER])) for i in range(0, len(some), TOGETHER)]
            found = []
            for encoded in self.tokenizer.encode_batch_fast(inputs, add_special_tokens=False):
                ids = np.array(encoded.ids, dtype=self.kind)
                data, at = ids.tobytes(), 0
                for end in (np.flatnonzero(ids == cut) * width).tolist():
                    found.append(data[at:end])
                    at = end + width
                found.append(data[at:])
            self._remember(dict(zip(some, found, strict=True)))

    def _remember(self, ids: dict[str, bytes]) -> None:
        self.known.update(ids)
        self.size += sum(map(len, ids)) + sum(map(len, ids.values())) + ENTRY * len(ids)

    def forget(self) -> None:
        """Drop what a task has learnt: worker processes live on, and their memory is shared with what runs next."""
        self.known, self.before, self.size = {}, {}, 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the SentencePiece library agrees."""
        parts = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        joined = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        ids = [np.frombuffer(own, dtype=self.kind).astype(np.int32) for own in joined]
        if self.check is None:
            return ids, [True] * len(texts)
        same = [own == array(self.kind, theirs).tobytes() for own, theirs in zip(joined, self.check.encode(texts, num_threads=1), strict=True)]
        return ids, same

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids; the bytes of all pieces are looked up at once."""
        taken = self.surface.take(pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
        offsets, data = (memoryview(b or b"") for b in taken.buffers()[1:])
        ends = np.frombuffer(offsets, np.int32)[np.cumsum([0, *map(len, lists)])].tolist() if len(taken) else [0] * (len(lists) + 1)
        texts = [str(data[lo:hi], "utf-8", "replace") for lo, hi in zip(ends, ends[1:], strict=False)]
        return [t[1:] if self.model.dummy_prefix and t[:1] == " " else t for t in texts]


@lru_cache(maxsize=2)
def codec(path: str, verify: bool = True) -> Codec:
    """One per worker process: rebuilding the model takes a moment."""
    return Codec(path, verify)


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with so many characters together at most, or a single row."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids, round_trip (the ids decode to the text) and parity."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for batch in batches:
                for lo, hi in slices(pc.utf8_length(batch.column("text")).to_pylist()):
                    part = batch.slice(lo, hi - lo)
                    texts = part.column("text").to_pylist()
                    ids, same = own.encode_checked(texts)
                    lengths = np.array([len(x) for x in ids], dtype=np.int64)
                    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))
                    trip = [mine == t for mine, t in zip(own.decode_all(ids), texts, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), lists, pa.array(trip), pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip", "parity"])
        finally:
            own.forget()

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean, parity boolean")
