"""Order helpers: bucketed paths give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellwave.operators import ordinal


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        # one key holds a third of all rows, another key is null
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}"
        data.append((key, i, float(rng.randrange(1, 200)) / 8))
    return spark.createDataFrame(data, "k string, t bigint, v double").cache()


@pytest.mark.parametrize("width", [1, 97, 10**6])
def test_bucketed_ordinal(rows, width):
    want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("bigint") - 1)
    got = ordinal.bucketed_ordinal(rows, ["k"], ["t"], F.floor(F.col("t") / width))
    assert sorted(map(str, got.select("k", "t", "pos").collect())) == sorted(
        map(str, want.select("k", "t", "pos").collect())
    )


@pytest.mark.parametrize("width", [1, 61, 10**6])
def test_bucketed_lag(rows, width):
    want = rows.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    got = ordinal.bucketed_lag(rows, ["k"], "t", F.floor(F.col("t") / width), "v", "p")
    cols = ["k", "t", "p"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_running_sum(rows):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.t): r.s for r in rows.withColumn("s", F.sum("v").over(w)).collect()}
    got = ordinal.running_sum(rows, ["k"], "t", F.col("v"), "s", chunk=50).collect()
    assert len(got) == len(want)
    assert all(abs(r.s - want[r.k, r.t]) < 1e-9 for r in got)


@pytest.mark.parametrize("average", [False, True])
def test_median(rows, average):
    import statistics

    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append(r.v)
    f = statistics.median if average else statistics.median_low
    got = {r.k: r.m for r in ordinal.median(rows, ["k"], "v", "m", average).collect()}
    assert got == {k: f(v) for k, v in groups.items()}


def test_first_rows_per_key(rows):
    n = F.count("*").over(Window.partitionBy("k"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("t"))
    want = rows.withColumn("first", rank <= F.floor(n * 0.4))
    got = ordinal.first_rows_per_key(
        rows, ["k"], ["t"], F.floor(F.col("t") / 100), lambda c: F.floor(c * 0.4), "first"
    )
    cols = ["k", "t", "first"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_global_ordinal(rows):
    got, n = ordinal.global_ordinal(rows, [F.desc("v"), F.asc("t")], partitions=7)
    order = [r.t for r in got.orderBy("pos").collect()]
    assert n == 3000 and order == [r.t for r in rows.orderBy(F.desc("v"), "t").collect()]
    assert [r.pos for r in got.orderBy("pos").collect()] == list(range(3000))


def test_halo_covers_every_frame(spark):
    df = spark.range(100).withColumnRenamed("id", "t")
    out = ordinal.with_halo(df, "t", 16, 3, 2).collect()
    assert sum(r._own for r in out) == 100
    for c in range(7):
        held = {r.t for r in out if r._chunk == c}
        assert {t for t in range(16 * c - 3, 16 * c + 18) if 0 <= t < 100} <= held
