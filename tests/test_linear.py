"""Short-axis transforms in the JVM against the array kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.model import KEY, Signal
from cellwave.operators import radar, spectral


def signal(spark, axis, size, other=3, real=False, missing=(), declared=True):
    pick = np.random.default_rng(size)
    rows = [(s, k, c, *map(float, pick.normal(size=1 if real else 2))) for s in range(3) for k in range(size) for c in range(other)]
    rows = [r for r in rows if r[0] not in missing]
    names = "value double" if real else "re double, im double"
    cells = spark.createDataFrame(rows, f"{KEY} long, {axis} long, subc long, {names}")
    return Signal(cells, (axis, "subc"), sizes={axis: size, "subc": other} if declared else {})


CASES = {
    "fft": ("time", lambda s, m: spectral.fft(s, method=m)),
    "backward": ("time", lambda s, m: spectral.fft(s, norm="backward", method=m)),
    "inverse": ("freq", lambda s, m: spectral.inverse_fft(s, method=m)),
    "range": ("adc", lambda s, m: radar.range_fft(s, n_fft=12, method=m)),
    "doppler": ("chirp", lambda s, m: radar.doppler_fft(s, method=m)),
    "angle": ("ant", lambda s, m: radar.angle_fft(s, num_bins=16, method=m)),
    "fmcw": ("sample", lambda s, m: spectral.fmcw_demod(s, 1000.0, 50.0, 200.0, n_fft=8, method=m)),
}


def values(sig):
    return {tuple(r[:3]): complex(r.re, r.im) for r in sig.cells.collect()}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("real", [False, True])
def test_both_methods_agree(spark, name, real):
    axis, run = CASES[name]
    sig = signal(spark, axis, 7, real=real)
    sql, arrays = run(sig, "sql"), run(sig, "arrays")
    assert sql.axes == arrays.axes
    got, want = values(sql), values(arrays)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_the_size_chooses(spark, monkeypatch):
    plan = lambda sig: sig.cells._jdf.queryExecution().optimizedPlan().toString()
    short = spectral.fft(signal(spark, "time", 8))
    assert "Python" not in plan(short) and "Arrow" not in plan(short) and short.sizes["freq"] == 8
    assert "pythonUDF" in plan(spectral.fft(signal(spark, "time", 8, declared=False)))
    monkeypatch.setattr(spectral, "TABLE_ENTRIES", 63)
    assert "pythonUDF" in plan(spectral.fft(signal(spark, "time", 8)))
    with pytest.raises(ValueError, match="declared size"):
        spectral.fft(signal(spark, "time", 8, declared=False), method="sql")
    with pytest.raises(ValueError, match="unknown method"):
        spectral.fft(signal(spark, "time", 8), method="gpu")


def test_partial_sums_come_before_the_exchange(spark):
    out = spectral.fft(signal(spark, "time", 8)).cells
    plan = out._jdf.queryExecution().executedPlan().toString()
    joined, moved = plan.index("BroadcastHashJoin"), plan.index("Exchange hashpartitioning")
    assert moved < plan.index("partial_sum") < joined and plan.count("Exchange hashpartitioning") == 1
    assert out.filter(F.col("freq") > 7).isEmpty()
