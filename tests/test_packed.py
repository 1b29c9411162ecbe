"""Statistics of packed cells: values, one read, and hot samples in many chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.model import KEY, Signal
from cellwave.operators import normalize, packed


def signal(spark, rows, sizes=None, axes=("time", "subc")):
    return Signal(spark.createDataFrame(rows, f"{KEY} long, {', '.join(f'{a} long' for a in axes)}, value double"), axes, sizes=sizes or {})


def made(seed=1):
    pick = np.random.default_rng(seed)
    rows = [(s, t, c, float(pick.normal(s, 1 + c))) for s, n in ((1, 400), (2, 3), (3, 1)) for t in range(n) for c in range(3)]
    return rows + [(None, 0, 0, 4.0), (None, 1, 0, 8.0)]


@pytest.mark.parametrize("chunk", [8, 1 << 16])
@pytest.mark.parametrize("sizes", [{}, {"subc": 3}, {"time": 400, "subc": 3}])
def test_values_do_not_depend_on_chunks(spark, monkeypatch, chunk, sizes):
    monkeypatch.setattr(packed, "CHUNK_CELLS", chunk)
    rows = made()
    groups, series = {}, {}
    for s, t, c, v in rows:
        groups.setdefault(s, []).append(v)
        series.setdefault((s, c), []).append(v)
    sig = signal(spark, rows, sizes)
    got = {tuple(r[:3]): r.value for r in normalize.minmax(sig).cells.collect()}
    assert len(got) == len(rows)
    for s, t, c, v in rows:
        own = groups[s]
        assert got[s, t, c] == pytest.approx((v - min(own)) / (max(own) - min(own) + 1e-8))
    got = {tuple(r[:3]): r.value for r in normalize.zscore(sig).cells.collect()}
    for s, t, c, v in rows:
        assert got[s, t, c] == pytest.approx((v - np.mean(groups[s])) / np.std(groups[s], ddof=1))
    got = {tuple(r[:3]): r.value for r in normalize.axis_normalize(sig, "time", "l2").cells.collect()}
    for s, t, c, v in rows:
        assert got[s, t, c] == pytest.approx(v / np.linalg.norm(series[s, c]))


def test_spans(spark):
    sig = signal(spark, [(1, 0, 0, 1.0)], {"subc": 30})
    assert packed.chunk_spans(sig, [KEY]) == {"time": packed.CHUNK_CELLS // 30}
    assert packed.chunk_spans(sig, [KEY, "time"]) is None
    assert packed.chunk_spans(sig, [KEY, "subc"]) == {"time": packed.CHUNK_CELLS}
    wide = signal(spark, [(1, 0, 0, 1.0)], {"time": 1 << 20, "subc": 30})
    assert packed.chunk_spans(wide, [KEY]) == {"time": 256, "subc": 256}


def plan_of(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [{}, {"time": 400, "subc": 3}])
def test_cells_are_read_once(spark, tmp_path, sizes):
    signal(spark, made()).cells.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    out = normalize.minmax(Signal(cells, ("time", "subc"), sizes=sizes)).cells
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans, reused = plan.count("FileScan"), plan.count("ReusedExchange")
    assert scans - reused <= 1, plan


def test_a_hot_sample_is_many_rows(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_CELLS", 64)
    rows = [(7, t, c, float(t)) for t in range(1000) for c in range(3)]
    sig = signal(spark, rows, {"subc": 3})
    keys, spots = [KEY], packed.chunk_spans(sig, [KEY])
    sizes = sig.cells.groupBy(*keys, *(F.floor(F.col(a) / n) for a, n in spots.items())).count().select("count").collect()
    assert len(sizes) == 48 and max(s[0] for s in sizes) <= 64
    assert normalize.minmax(sig).cells.count() == 3000
