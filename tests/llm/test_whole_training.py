"""op 3 trains on every triple with its whole count."""

import numpy as np

from mercato.llm import op3_lm


def test_a_pass_has_every_triple_with_its_whole_count():
    n = np.r_[np.array([500_000, 40_000, 7]), np.ones(30_000, np.int64)]
    at, weight = op3_lm.rows_of(n, 4096)
    assert np.allclose(np.bincount(at, weight, minlength=len(n)), n) and weight.max() <= n.sum() / 4096 + 1
    assert len(n) <= len(at) <= len(n) + 4096


def test_triples_that_come_once_are_trained(monkeypatch):
    """More triples than a round has draws: the parameters of each one's first class move."""
    words = np.arange(op3_lm.N_CLASS - 2)
    rare = words * op3_lm.N_CLASS**2 + 5 * op3_lm.N_CLASS + 7  # one triple for each first class
    triple = np.r_[rare, (op3_lm.N_CLASS - 1) * op3_lm.N_CLASS**2 + 5 * op3_lm.N_CLASS + 7]
    n = np.r_[np.ones(len(rare), np.int64), 10**7]
    noise = np.full(op3_lm.N_CLASS, 1 / op3_lm.N_CLASS)
    theta = op3_lm.start(noise)
    got = op3_lm.nce(theta, triple, n, noise, steps=4, seed=1, batch=64)
    moved = np.abs(op3_lm.unpack(got)[0] - op3_lm.unpack(theta)[0]).max(1)
    assert (moved[words] > 0).all()
