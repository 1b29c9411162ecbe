"""Sliding order statistics against sorting every window."""

import math

import numpy as np
import pytest

from cellwave.functions import kernels


def plain(x, half, limit):
    out = []
    for k in range(len(x)):
        own = sorted(x[max(k - half, 0) : k + half + 1], key=lambda v: (abs(v), v.real, v.imag))
        m = len(own)
        median = abs(own[(m + 1) // 2 - 1])
        deviation = sorted(abs(abs(v) - median) for v in own)[(m + 1) // 2 - 1]
        out.append(own[m // 2] if abs(abs(x[k]) - median) > limit * deviation else x[k])
    return out


@pytest.mark.parametrize("sorted_window", [0, 64])
@pytest.mark.parametrize("half", [0, 1, 2, 5, 20, 200])
def test_hampel_kernel(monkeypatch, sorted_window, half):
    monkeypatch.setattr(kernels, "SORTED_WINDOW", sorted_window)
    pick = np.random.default_rng(half)
    rows = [pick.normal(size=61), pick.integers(-2, 3, 61).astype(float), np.zeros(61), np.arange(61.0)]
    rows += [pick.integers(-2, 3, 61) + 1j * pick.integers(-1, 2, 61), pick.normal(size=61) * np.exp(2j * pick.normal(size=61))]
    for row in rows:
        for limit in (0.5, 3 * 1.4826):
            assert kernels.hampel(row[None], half, limit)[0].tolist() == plain(row.tolist(), half, limit)
    assert kernels.hampel(np.zeros((1, 0)), half, 1.0).shape == (1, 0)


def test_ranks_of_stretches():
    pick = np.random.default_rng(9)
    for n in (1, 2, 7, 64, 100):
        ranks = pick.permutation(n)
        tree = kernels.RangeRanks(ranks)
        low = pick.integers(0, n, 200)
        high = np.minimum(low + 1 + pick.integers(0, n, 200), n)
        k = (pick.random(200) * (high - low)).astype(int)
        assert tree.smallest(low, high, k).tolist() == [sorted(ranks[a:b])[c] for a, b, c in zip(low, high, k)]


def test_a_nan_is_the_largest():
    x = np.array([[1.0, 2.0, math.nan, 2.0, 1.5, 1.0]])
    assert not np.isnan(kernels.hampel(x, 2, 3.0)).any()
