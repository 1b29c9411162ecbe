"""Two-level resampling: exact numbers of draws, right frequencies, bounded shares of hot weight."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwave.operators import sampling
from cellwave.workload import all_queries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(1e-6, 1e6), min_size=1, max_size=40))
def test_tables_hold_the_weights(weights):
    w = np.array(weights)
    keep, other = sampling.alias_table(w)
    got = np.bincount(other, np.clip(1 - keep, 0, 1), len(w)) + np.clip(keep, 0, 1)
    np.testing.assert_allclose(got / len(w), w / w.sum(), rtol=1e-6, atol=1e-9)


def rows(spark, weights, partitions=4):
    data = [(k, None if w is None else float(w), f"r{k}") for k, w in enumerate(weights)]
    return spark.createDataFrame(data, "pos long, w double, name string").repartition(partitions)


def test_frequencies_and_numbers(spark):
    weights = [0.0, None, -1.0, *(1 + k % 7 for k in range(4000)), 8000.0]
    df = rows(spark, weights)
    got = sampling.alias_resample(df, "w", 5, part_rows=256)
    assert got.columns == ["pos", "w", "name", "draw"]
    found = got.collect()
    assert sorted(r.draw for r in found) == list(range(len(weights)))
    counts = np.bincount([r.pos for r in found], minlength=len(weights))
    assert counts[:3].sum() == 0 and all(r.name == f"r{r.pos}" for r in found)
    w = np.array([max(x or 0, 0) for x in weights])
    for kind in range(1, 8):
        own = w == kind
        want = len(found) * w[own].sum() / w.sum()
        assert abs(counts[own].sum() - want) < 5 * np.sqrt(want)
    want = len(found) * 8000 / w.sum()
    assert abs(counts[-1] - want) < 5 * np.sqrt(want)


def test_partitioning_does_not_matter(spark):
    weights = [k % 11 + 0.5 for k in range(900)]
    one, two = (sampling.alias_resample(rows(spark, weights, n), "w", 3, part_rows=100) for n in (2, 7))
    pairs = lambda df: sorted((r.draw, r.pos) for r in df.collect())
    assert pairs(one) == pairs(two)
    assert pairs(sampling.alias_resample(rows(spark, weights), "w", 4, part_rows=100)) != pairs(one)


@pytest.mark.parametrize("weights", [[], [0.0, None], [3.0]])
def test_few_rows(spark, weights):
    df = rows(spark, weights, 1)
    assert sampling.alias_resample(df, "w", 1).count() == sum(bool(w) for w in weights)


def test_hot_weight_is_drawn_in_shares(spark):
    df = rows(spark, [1e6] + [1.0] * 2999)
    got = sampling.alias_resample(df, "w", 1, part_rows=200)
    number = F.floor(F.col("draw") / 1)  # draws of a share are consecutive and at most 200
    assert got.filter("pos = 0").count() > 2900 and got.select(number).distinct().count() == 3000


def test_query(spark):
    got = all_queries()["alias_resample"](spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert got.count() == events.count() == got.select("draw").distinct().count()
    drawn = got.join(events, "event_id")
    low, high = drawn.agg(F.avg("value")).first()[0], events.agg((F.sum(F.col("value") ** 2) / F.sum("value"))).first()[0]
    assert low == pytest.approx(high, rel=0.1)
