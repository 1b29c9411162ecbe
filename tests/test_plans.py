"""Plan shapes, layout invariance, composition and presets."""

import re

import pytest
from pyspark.sql import functions as F

from cellwave.model import Signal
from cellwave.operators import adapters, normalize
from cellwave.plans import compose, presets
from cellwave.workload import all_queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()



@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_cross_joins_or_row_udfs(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text


# windows over a few summary rows: bucket totals, partition totals and members of one batch
SUMMARY_WINDOWS = {
    "shuffled_order", "weighted_resample", "batch_pointsets", "dataset_from_samples", "encode_first_appearance",
    "encode_sorted", "group_split_ratio", "key_parts", "select_positions", "sorted_group_partition",
}


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SUMMARY_WINDOWS))
def test_no_single_partition_window(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow\b", line):
            below = " ".join(lines[i : i + 4])
            assert "SinglePartition" not in below, below


def test_scans_are_pruned(spark):
    text = plan(all_queries()["label_histogram"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in text
    text = plan(all_queries()["metadata_split"](spark, FOLDER))
    assert "In(o_orderstatus" in text


def test_stratified_split_ranks_single_buckets(spark):
    text = plan(all_queries()["stratified_train_val"](spark, FOLDER))
    # rows are ranked inside the bucket of the cut only
    ranked = [line for line in text.splitlines() if "row_number" in line and "Window [" in line]
    assert ranked and all("_bucket" in line for line in ranked)


@pytest.mark.parametrize("name", ["clean_and_split", "dataset_from_samples", "zscore_real", "stft", "sample_rates", "weighted_resample"])
def test_layout_does_not_change_results(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = all_queries()[name](spark, FOLDER)
            seen.add(tuple(sorted(map(str, df.collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def tiny(spark):
    cells = spark.createDataFrame([(0, i, j, float(i + j)) for i in range(3) for j in range(2)], "sample_id int, time int, subc int, value double")
    return Signal(cells, ("time", "subc"), spark.createDataFrame([(0, "r")], "sample_id int, reader_id string"))


def test_signal_checks(spark):
    cells = tiny(spark).cells
    with pytest.raises(ValueError, match="lacks"):
        Signal(cells, ("time", "nope"))
    with pytest.raises(ValueError, match="unique"):
        Signal(cells, ("time", "time"))
    with pytest.raises(ValueError, match="value"):
        Signal(cells.drop("value"), ("time",))


def test_compose_and_provenance(spark):
    chain = compose.compose(compose.step(normalize.minmax), compose.step(adapters.to_sequence, flatten_axes=["subc"]))
    out = chain(tiny(spark))
    assert out.axes == ("time", "feature")
    names = [r.name for r in out.samples.first().transforms]
    assert names == ["minmax", "to_sequence"]
    assert out.samples.first().transforms[1].produced == ["feature"]


def test_keyed_needs_its_keys(spark):
    run = compose.keyed(normalize.minmax, ["a"], ["b"])
    assert set(run({"a": tiny(spark)})) == {"a", "b"}
    with pytest.raises(KeyError, match="lacks"):
        run({"x": tiny(spark)})
    with pytest.raises(ValueError):
        compose.keyed(normalize.minmax, ["a"], [])


def test_presets_record_their_steps(spark):
    sig = tiny(spark)
    assert presets.radar_cube().__name__ == presets.csi_sequence(sample_zscore=True).__name__ == "run"
    with pytest.raises(ValueError):
        presets.radar_cube()(sig)


def test_alignment_errors(spark):
    sig = tiny(spark)
    image = adapters.InputContract(("channel", "height", "width"))
    with pytest.raises(ValueError, match="make up"):
        adapters.auto_align(sig, image)
    with pytest.raises(ValueError, match="make up"):
        adapters.auto_align(sig, adapters.InputContract(("a", "b")))
    generic = adapters.auto_align(sig, adapters.InputContract(("a", "b")), {"a": "subc", "b": "time"})
    assert generic.axes == ("a", "b")
    fixed = adapters.InputContract(("time", "subc"), fixed_sizes={"time": 4, "subc": 2})
    assert [(r.axis, r.expected, r.actual) for r in adapters.contract_problems(sig, fixed).collect()] == [("time", 4, 3)]


def test_point_statistics_of_empty_frames(spark):
    points = spark.createDataFrame([(0, 0, 2.0), (0, 0, 4.0)], "sample_id int, time int, x double")
    frames = spark.createDataFrame([(0, 0), (0, 1)], "sample_id int, time int")
    rows = {r.time: r for r in adapters.point_statistics(points, ["sample_id", "time"], ["x"], frames=frames).collect()}
    assert (rows[0].mean_x, rows[0].max_x, rows[0].std_x) == (3.0, 4.0, 1.0)
    assert (rows[1].mean_x, rows[1].max_x, rows[1].std_x) == (0.0, 0.0, 0.0)
