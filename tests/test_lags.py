"""Autocorrelation at all lags: each series' length chooses the way."""

import numpy as np
import pytest

from cellwave.model import KEY, Signal
from cellwave.operators import spectral


@pytest.mark.parametrize("sizes", [{"rx": 2}])
@pytest.mark.parametrize("chunk", [8, 1000])
def test_length_chooses(spark, chunk, sizes):
    pick = np.random.default_rng(3)
    values = {(s, r): pick.normal(size=n) for s, n in ((1, 24), (2, 6), (3, 1)) for r in range(2)}
    rows = [(s, t, r, float(v)) for (s, r), own in values.items() for t, v in enumerate(own)]
    sig = Signal(spark.createDataFrame(rows, f"{KEY} long, time long, rx long, value double"), ("time", "rx"), sizes=sizes)
    got = {}
    for r in spectral.autocorrelation(sig, normalized=False, chunk=chunk).cells.collect():
        got.setdefault((r.sample_id, r.rx), {})[r.lag] = r.value
    for k, own in values.items():
        want = [float(own[: len(own) - lag] @ own[lag:]) for lag in range(len(own))]
        assert sorted(got[k]) == list(range(len(own)))
        np.testing.assert_allclose([got[k][lag] for lag in range(len(own))], want, atol=1e-9)


def test_declared_sizes_choose_at_once(spark):
    rows = [(1, t, float(t)) for t in range(12)]
    cells = spark.createDataFrame(rows, f"{KEY} long, time long, value double")
    plan = lambda chunk: spectral.autocorrelation(Signal(cells, ("time",), sizes={"time": 12}), chunk=chunk).cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan(100).count("pythonUDF") < plan(4).count("pythonUDF")
