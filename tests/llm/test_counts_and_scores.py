"""Token counts against the library, unigram scores and the attention model against plain computations."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cases import ODD, documents, key  # noqa: I001
from flowledger.llm import lm_scoring, sentencepiece_codec, term_sums, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BPE).collect())
    library = Tokenizer.from_file(BPE)
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((key(r.doc_id), len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_token_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(term_sums, "HELD_SUMS", 5)
    docs = documents(spark)
    small = token_counts.token_counts(docs, BPE)
    monkeypatch.undo()
    assert sorted(map(str, small.collect())) == sorted(map(str, token_counts.token_counts(docs, BPE).collect()))


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.token_counts(none, BPE).count() == 0
    assert lm_scoring.score_texts(none, PIECES, rounds=1).count() == 0
    assert sentencepiece_codec.encode_decode(none, PIECES).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    return lm_scoring.score_texts(documents(spark), PIECES, train_share=4, rounds=2).collect()


def test_unigram_scores(spark, scored):
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in documents(spark).collect()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for h, (_, ws) in zip(held, rows, strict=True) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((key(i), h, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 6)) for h, (i, ws) in zip(held, rows, strict=True))
    got = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored)
    assert got == want
    assert {r.train_tokens for r in scored} == {total}


def test_held_out_texts_are_better_than_chance(scored):
    held = [r for r in scored if r.held_out]
    uniform = lm_scoring.score_texts  # the bound below is that of a uniform choice among all subword ids
    assert uniform and held
    ids = sum(r.n_tokens for r in held) * 2  # at least two ids a word in these texts
    assert sum(r.score for r in held) > -ids * math.log10(32_000)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def net(seed=1):
    n = 2 * lm_scoring.BINS + 1
    return lm_scoring.Net(np.random.default_rng(seed).normal(0, 0.3, lm_scoring.Net.size(n)), n)


def test_windows_score_every_place_once_with_the_ids_before_it():
    model, rng = net(), np.random.default_rng(3)
    texts = [rng.integers(0, 40, n) for n in (0, 1, 15, 16, 17, 27, 28, 29, 100)]
    got = lm_scoring.log_scores(model, texts, model.n - 1)
    for ids, score in zip(texts, got, strict=True):
        sequence, total = [model.n - 1, *ids, model.n - 1], 0.0
        for t in range(len(sequence) - 1):
            start = 0 if t < lm_scoring.WINDOW else (t - (lm_scoring.WINDOW - lm_scoring.STEP)) // lm_scoring.STEP * lm_scoring.STEP
            x = np.full((1, lm_scoring.WINDOW), model.n - 1)
            x[0, : t + 1 - start] = sequence[start : t + 1]
            z = model.attend(x)[-1][0, t - start]
            logits = z @ model.out + model.bias
            total += logits[sequence[t + 1]] - np.log(np.exp(logits).sum())
        assert math.isclose(score, total, rel_tol=1e-9)


def test_gradient_by_differences():
    model, rng = net(2), np.random.default_rng(4)
    x, y, scored, _ = lm_scoring.windows([rng.integers(0, 40, n) for n in (0, 5, 40)], model.n - 1)

    def loss(flat):
        other = lm_scoring.Net(flat, model.n)
        logits = other.attend(x)[-1] @ other.out + other.bias
        log_p = logits - np.log(np.exp(logits).sum(-1, keepdims=True))
        return -(np.take_along_axis(log_p, y[..., None], -1)[..., 0] * scored).sum() / scored.sum()

    gradient = model.gradient(x, y, scored)
    for i in rng.integers(0, len(model.flat), 40):
        up, down = model.flat.copy(), model.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - gradient[i]) < 1e-6


def test_class_probabilities_add_up():
    pieces = sentencepiece_codec.parse_model(open(PIECES, "rb").read()).pieces
    classes = lm_scoring.Classes(pieces, np.arange(len(pieces)) % 50.0)
    assert np.allclose(np.bincount(classes.of, weights=np.exp(classes.log_share), minlength=classes.size)[:-1][np.unique(classes.of)], 1)


def test_codec_parity_and_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark)
    got = sorted((key(r.doc_id), r.n_tokens, list(r.ids), r.round_trip, r.parity) for r in sentencepiece_codec.encode_decode(docs, PIECES).collect())
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((key(r.doc_id), len(ids), ids, True, True))
    assert got == sorted(want)


def test_codec_on_random_texts():
    import random

    import sentencepiece

    random.seed(5)
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    texts = ["".join(random.choice("aab  \n\t▁é日\U0001f600<s>0x1.,'") for _ in range(random.randint(0, 30))) for _ in range(2000)]
    texts += [" " * n + "x" for n in range(30)] + ["aaaa" * n for n in range(1, 15)]
    ids, same = own.encode_checked(texts)
    assert [i.tolist() for i in ids] == library.encode(texts) and all(same)
    assert [own.decode(i) for i in ids] == [library.decode(i.tolist()) for i in ids]


def test_unigram_model_is_rebuilt():
    """A unigram model made up by hand: the best segmentation by score, with bytes for unknown characters."""
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁", -3.0, 1), ("a", -2.5, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    model = sentencepiece_codec.Model(pieces, sentencepiece_codec.UNIGRAM, True, False, b"", True, False, True)
    encoded = sentencepiece_codec.backend(model).encode("▁abab", add_special_tokens=False).ids
    assert [pieces[i][0] for i in encoded] == ["▁a", "b", "ab"]


def test_odd_rows_are_as_many():
    assert len(ODD) == 12


def test_parity_is_told_from_whole_texts():
    """Signs after a word are encoded apart, and were never compared with the library."""
    own = sentencepiece_codec.Codec(PIECES)
    texts = ["wordy words, others", "plain words"]
    assert own.encode_checked(texts)[1] == [True, True]
    signs = next(w for w in own.known if w.startswith("\0"))
    own.forget()
    own.learn({signs})
    own.known[signs] += own.known[signs]
    assert own.encode_checked(texts)[1] == [False, True]


def test_the_model_learns_from_every_training_text(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(200)] + [(None, "no id")]
    learnt = []

    def train(texts, classes, weights, path, rounds):
        learnt.extend(r.text for r in texts.select("text").collect())
        return weights

    monkeypatch.setattr(lm_scoring, "train", train)
    lm_scoring.score_texts(documents(spark, rows), PIECES)
    assert sorted(learnt) == sorted(t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10)


def test_codec_takes_many_words_as_one_input():
    """Distinct words meet the backend in few inputs, also those that hold what stands between words or begin with a NUL."""
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES)
    inputs, plain = [], own.tokenizer

    class Counted:
        def encode_batch_fast(self, batch, **options):
            inputs.extend(batch)
            return plain.encode_batch_fast(batch, **options)

    own.tokenizer = Counted()
    odd = sentencepiece_codec.BETWEEN
    texts = [" ".join(f"w{i}x{i * 7}." for i in range(3000)), f"a{odd}b {odd} {odd}{odd}c", "a \0b \0 c", "\0a b", "", odd]
    ids, same = own.encode_checked(texts)
    assert [i.tolist() for i in ids] == library.encode(texts) and all(same)
    assert len(inputs) <= 3010 / sentencepiece_codec.TOGETHER + 1


def id_net(seed=6):
    """A model in double precision over a small vocabulary, some of whose classes hold several ids."""
    pieces = [(f"{'▁' * (i % 2)}p{i}", 0.0, 1) for i in range(120)]
    classes = lm_scoring.Classes(pieces, np.random.default_rng(seed).integers(0, 50, 120).astype(float))
    size = lm_scoring.Net.size(classes.size) + lm_scoring.IdNet.own_size(classes)
    return lm_scoring.IdNet(np.random.default_rng(seed).normal(0, 0.3, size), classes), classes


def test_probabilities_of_ids_add_up():
    model, classes = id_net()
    z = np.repeat(np.random.default_rng(7).normal(0, 1, (5, lm_scoring.WIDTH)), 121, axis=0)
    for shift in (False, True):
        assert np.allclose(np.exp(model.chosen(z, np.tile(np.arange(121), 5), shift)).reshape(5, 121).sum(axis=1), 1)


def test_scores_of_ids_are_those_of_classes_and_shares_where_ids_have_no_weights():
    model, classes = id_net()
    model.enter[:], model.leave[:], model.lean[:] = 0, 0, classes.share_of_place
    texts = [np.random.default_rng(8).integers(0, 120, n) for n in (0, 1, 16, 17, 60)]
    of_classes = lm_scoring.log_scores(lm_scoring.Net(model.flat[: lm_scoring.Net.size(classes.size)], classes.size), [classes.of[t] for t in texts], classes.end)
    got = lm_scoring.log_scores(model, [classes.place[t] for t in texts], classes.end_place)
    assert np.allclose(got, of_classes + [classes.log_share[t].sum() for t in texts])


def test_gradient_of_ids_by_differences(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CELLS", 6)
    model, classes = id_net()
    x, y, scored, _ = lm_scoring.windows([np.random.default_rng(9).integers(0, 120, n) for n in (0, 5, 40)], classes.end_place)

    def loss(flat):
        other = lm_scoring.IdNet(flat, classes)
        return -other.chosen(other.attend(x)[-1][scored], y[scored]).sum() / scored.sum()

    gradient = model.gradient(x, y, scored)
    assert np.count_nonzero(gradient[lm_scoring.Net.size(classes.size) :])
    for i in np.random.default_rng(10).integers(0, len(model.flat), 200):
        up, down = model.flat.copy(), model.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - gradient[i]) < 1e-6


def test_ids_of_one_class_are_told_apart_by_what_is_before_them(spark):
    """Words that are equally frequent share a class; which of them follows is learnt."""
    pieces = sentencepiece_codec.parse_model(open(PIECES, "rb").read()).pieces
    found = [p[1:] for p, _, kind in pieces if kind == 1 and p[0] == "▁" and p[1:].isascii() and p[1:].isalpha() and p[1:].islower() and len(p) > 4]
    single = [w for w in found[:2000] if len(lm_scoring.encoder(PIECES).ids([[w]])[0]) == 1][:64]
    pairs = list(zip(single[:32], single[32:], strict=True))
    kept = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10][:2000]
    rows = [(i, " ".join(" ".join(pairs[j]) for j in np.random.default_rng(i).integers(0, 32, 128))) for i in kept]
    held = [i for i in range(100_000, 110_000) if zlib.crc32(str(i).encode()) % 10 == 0][:64]
    rows += [(held[2 * i + wrong], " ".join(w for j in range(6) for w in (pairs[(i + 5 * j) % 32][0], pairs[(i + 5 * j) % 32 ^ wrong][1]))) for i in range(32) for wrong in (0, 1)]
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(documents(spark, rows).coalesce(1), PIECES).collect()}
    assert all(score[held[2 * i]] > score[held[2 * i + 1]] + 10 for i in range(32))
