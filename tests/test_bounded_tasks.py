"""Work is dealt to tasks before it grows, and short series stay in the JVM."""

import numpy as np
from cellwave.model import Signal
from cellwave.operators import catalogue, spectral


def test_ranges_grow_after_they_are_dealt(spark):
    df = spark.createDataFrame([(1, "1:3,7", "3"), (1, "9", "1"), (2, None, "5:6,5"), (None, "4", "4")], "k long, a string, b string")
    out = catalogue.expand_index_ranges(df.coalesce(1), ["k"], {"low": "a", "high": "b"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.rindex("Generate explode") < plan.index("Exchange hashpartitioning(k")
    want = {(1, 1): "high", (1, 2): "low", (1, 3): "high", (1, 7): "low", (1, 9): "low", (2, 5): "high", (2, 6): "high", (None, 4): "high"}
    assert {(r.k, r["index"]): r.label for r in out.collect()} == want


def test_lags_of_short_series_need_no_python(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal())) for s, n in enumerate((1, 2, 5, 8)) for t in range(n)]
    cells = spark.createDataFrame(rows, "sample_id long, time long, value double")
    sig = Signal(cells.repartition(5), ("time",), sizes={"time": 8})
    for normalized in (False, True):
        out = spectral.autocorrelation(sig, normalized=normalized).cells
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.sample_id, r.lag): r.value for r in out.collect()}
        want = {}
        for s in range(4):
            x = np.array([v for k, _, v in rows if k == s])
            full = np.correlate(x, x, "full")[len(x) - 1 :]
            want |= {(s, lag): v / (full[0] if normalized else 1) for lag, v in enumerate(full)}
        assert got.keys() == want.keys() and len(got) == 16
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-12)
