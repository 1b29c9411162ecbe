"""Filters that carry their state over chunks against whole series."""

import numpy as np
import pytest

from cellwave.functions.kernels import butterworth, iir, iir_states, zero_phase
from cellwave.model import KEY, Signal
from cellwave.operators import series


def signal(spark, lengths, rx=2, seed=1):
    pick = np.random.default_rng(seed)
    values = {(s, r): np.cumsum(pick.normal(size=n) + 1j * pick.normal(size=n)) for s, n in lengths.items() for r in range(rx)}
    rows = [(s, t, r, float(v.real), float(v.imag)) for (s, r), own in values.items() for t, v in enumerate(own)]
    cells = spark.createDataFrame(rows, f"{KEY} long, time long, rx long, re double, im double").repartition(5)
    return Signal(cells, ("time", "rx")), values


def test_state_after_each_length():
    b, a = butterworth(3, 40.0, 1000.0, "low")
    x = np.random.default_rng(2).normal(size=(2, 200))
    for n in (1, 63, 64, 65, 130):
        _, state = iir_states(x[:, :n], b, a, np.zeros((2, 3)))
        np.testing.assert_allclose(iir(x[:, n:], b, a, state), iir(x, b, a, np.zeros((2, 3)))[:, n:], atol=1e-12)


@pytest.mark.parametrize("chunk", [100, 256])
def test_long_memory_needs_no_halo(spark, monkeypatch, chunk):
    rate, low, high = 1e6, 20000.0, 2.0  # the high-pass remembers millions of samples
    sig, values = signal(spark, {1: 1000, 2: 255, 3: 40, None: 310})
    out = series.temporal_filter(sig, rate, low, high, 2, 1, chunk=chunk)
    stages = [butterworth(2, low, rate, "low"), butterworth(1, high, rate, "high")]
    want = {k: v[None] for k, v in values.items()}
    for b, a in stages:
        want = {k: zero_phase(v, b, a) for k, v in want.items()}
    got = {}
    for r in out.cells.collect():
        got.setdefault((r.sample_id, r.rx), {})[r.time] = complex(r.re, r.im)
    assert got.keys() == want.keys()
    for k, own in want.items():
        assert sorted(got[k]) == list(range(own.shape[1]))
        np.testing.assert_allclose([got[k][t] for t in range(own.shape[1])], own[0], atol=1e-8)


def test_both_ways_agree_where_the_halo_is_short(spark):
    sig, _ = signal(spark, {1: 900, 2: 333})
    args = dict(lowpass_hz=200.0, highpass_hz=60.0, lowpass_order=6, highpass_order=3)
    halo = series.temporal_filter(sig, 1000.0, **args, chunk=4096)
    scan = series.temporal_filter(sig, 1000.0, **args, chunk=100)
    assert "filter-packs" in scan.cells._jdf.queryExecution().toString() and "filter-packs" not in halo.cells._jdf.queryExecution().toString()
    rows = halo.cells.join(scan.cells.withColumnsRenamed({"re": "x", "im": "y"}), [KEY, "time", "rx"]).collect()
    assert len(rows) == 2 * 1233
    assert max(abs(complex(r.re - r.x, r.im - r.y)) for r in rows) < 1e-8


def test_series_and_chunks_that_are_too_short(spark):
    sig, _ = signal(spark, {1: 5})
    with pytest.raises(Exception, match="not longer than the padding"):
        series.temporal_filter(sig, 1e6, 20000.0, 2.0, 2, 1, chunk=100).cells.collect()
    with pytest.raises(ValueError, match="not longer"):
        series.temporal_filter(sig, 1e6, 20000.0, 2.0, 2, 1, chunk=9)
