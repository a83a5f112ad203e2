"""long segments go in blocks that step together, with the results of going site by site."""

from dataclasses import replace

import numpy as np
import pytest

from cytolake.operators import durations


def _values(seed, n):
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        size = int(r.integers(1, 60))
        out += list(r.beta(*[(2, 9), (5, 5), (9, 2)][int(r.integers(0, 3))], size))
    return np.array(out[:n])


@pytest.mark.parametrize("seed, n, longest", [(1, 400, 30), (2, 333, 200), (3, 257, 5), (4, 128, 1), (5, 449, 64)])
def test_blocks_are_site_by_site(monkeypatch, seed, n, longest):
    monkeypatch.setattr(durations, "BLOCK", 64)
    x = _values(seed, n)
    model = replace(durations.DurationModel(((2.0, 9.0), (5.0, 5.0), (9.0, 2.0)), (12.0, 0.4), (6.0, 0.9), 0.05, 0.3, longest, (0.2, 0.5, 0.3)))
    got, want = durations._in_blocks(model, x), durations._by_logs(model, x)
    assert got is not None
    assert np.abs(got[0] - want[0]).max() < 1e-9
    assert abs(got[1] - want[1]) < 1e-7 and abs(got[2] - want[2]) < 1e-7


def test_long_values_of_one_kind_and_extremes(monkeypatch):
    """Where borders forget slowly, or numbers get too small, the result is the same."""
    monkeypatch.setattr(durations, "BLOCK", 32)
    model = durations.DurationModel(((60.0, 900.0), (30.0, 30.0), (900.0, 60.0)), longest=40)
    for x in (np.full(200, 0.06), np.tile([1e-12, 1 - 1e-12], 80), np.concatenate([np.full(90, 0.06), np.full(90, 0.94)])):
        got, want = durations.posteriors(model, x), durations._by_logs(model, x)
        assert np.abs(got[0] - want[0]).max() < 1e-8
        assert abs(got[1] - want[1]) < 1e-6 * abs(want[1])


def test_long_segments_take_blocks(monkeypatch):
    calls = []
    monkeypatch.setattr(durations, "_by_logs", lambda model, x: calls.append(len(x)))
    durations.posteriors(durations.DurationModel(((2.0, 9.0), (5.0, 5.0), (9.0, 2.0))), _values(6, 5000))
    assert not calls
