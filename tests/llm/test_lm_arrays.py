"""The language model's steps over many texts at once, against the same written out for one text or one token."""

import time

import numpy as np
import pyarrow as pa
import pytest

from surveyloom.llm import lm

ODD = [b"", b" ", b"a", b"A b\tC\x0bd\x0c\r\n", b"x" * 300 + b" y" * 3, "é b  c É".encode(), b"", b"z" * 33 + b" " + b"q" * 32, b"\x00 \x1c\x85\xa0", b"end ", b"end"]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
@pytest.mark.parametrize("texts", [ODD, [b"", b""], [b"one"]])
def test_tokens_and_codes(texts, piece, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", piece)
    for column in (pa.array(texts, pa.binary()), pa.array([b"not this", *texts], pa.binary())[1:], pa.array(texts, pa.large_binary())):
        words, codes, ends, at = [], [], [], 0
        for piece_at, some in lm.tokens(column):
            assert piece_at.start == at and piece_at.stop - at == len(some.counts)
            at = piece_at.stop
            words += some.words.to_pylist()
            codes.append(some.with_ends(lm.word_codes(some.words), 0))
            ends += (some.counts + 1).tolist()
            which, found = lm.distinct_words(some.words)
            assert found.take(pa.array(which)).equals(some.words) and len(set(found.to_pylist())) == len(found)
        plain = [lm.encoded(t, lm.Memo(lm._code)) for t in texts]
        assert at == len(texts) and words == [w for x, _ in plain for w in x]
        assert np.concatenate(codes).tolist() == [c for _, x in plain for c in x.tolist()]
        assert ends == [len(x) for _, x in plain]


def some_table(scale):
    rng = np.random.default_rng(2)
    table = (scale * rng.normal(size=(lm.TABLE, lm.CLASSES))).astype(np.float32)
    rows = np.stack([rng.integers(0, lm.ROWS, 20_000) + i * lm.ROWS for i in range(lm.FEATURES)], axis=1)
    return table, rows, rng.integers(0, lm.CLASSES, len(rows))


@pytest.mark.parametrize("scale", [1, 5, 100])
def test_own_log_probs(scale):
    """Also where products of weights leave the range of numbers."""
    table, rows, cls = some_table(scale)
    want = lm.class_log_probs(table, rows)[np.arange(len(cls)), cls]
    assert np.allclose(lm.own_log_probs(table, rows, cls), want, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("scale", [1, 100])
def test_draws_have_the_model_s_probabilities(scale):
    table, rows, _ = some_table(scale)
    rows, rng, weights = rows[:500], np.random.default_rng(3), lm.Weights()
    weights.set(table)
    n = np.zeros((500, lm.CLASSES))
    for _ in range(400):
        n[np.arange(500), lm.draw(weights, rows, rng)] += 1
    p = np.exp(lm.class_log_probs(table, rows).astype(float))
    z = (n - 400 * p) / np.sqrt(400 * p * (1 - p) + 1e-9)
    assert abs(z[(p > 0.02) & (p < 0.98)]).max() < 6
    assert n[p < 1e-12].sum() == 0 and (n[p > 0.9999] > 390).all()


def test_a_token_costs_no_exponentials():
    """A token's own class costs well under what all of its classes' logarithms cost."""
    table, rows, cls = some_table(1)
    rows, cls = np.tile(rows, (4, 1)), np.tile(cls, 4)

    def seconds(f):
        best = []
        for _ in range(3):
            at = time.process_time()
            f()
            best.append(time.process_time() - at)
        return min(best)

    every = seconds(lambda: [lm.class_log_probs(table, rows[i : i + lm.SLICE]) for i in range(0, len(rows), lm.SLICE)])
    assert seconds(lambda: lm.own_log_probs(table, rows, cls)) < every / 2
