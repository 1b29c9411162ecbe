"""Edge rows of manifests, splits, leakage and labels."""

import pytest
from pyspark.sql import functions as F

from cellwave.operators import catalogue, labels, leakage, manifest, sampling, splits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_group_split_errors_and_string_order(spark):
    df = frame(spark, [(i, g) for i, g in enumerate([2, 10, 2, 30])], "sample_id bigint, g bigint")
    got = {r.g: r.side for r in splits.group_split(df, "g", 0.67).collect()}
    # "10" < "2" < "30"
    assert got == {10: "left", 2: "left", 30: "right"}
    with pytest.raises(ValueError, match="at least two"):
        splits.group_split(df.where("g = 2"), "g", 0.5)
    with pytest.raises(ValueError, match="define"):
        splits.group_split(df.withColumn("g", F.when(F.col("g") != 2, F.col("g"))), "g", 0.5)
    with pytest.raises(ValueError, match="overlapping"):
        splits.group_split(df, "g", left_values=[2], right_values=[2, 10])
    with pytest.raises(ValueError, match="ratio"):
        splits.group_split(df, "g", 1.0)


def test_group_split_two_fields(spark):
    df = frame(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "a", 1)], "sample_id int, x string, y int")
    got = {r.sample_id: r.side for r in splits.group_split(df, ["x", "y"], 0.5).collect()}
    assert got[1] == got[4] == "left" and got[3] == "right"


def test_side_problems(spark):
    df = frame(spark, [(1,), (2,), (None,)], "g int")
    found = {(r.problem, r.group) for r in splits.group_side_problems(df, "g", [1], [3]).collect()}
    assert found == {("missing_key", None), ("uncovered", "2"), ("empty_side", "right")}
    empty = splits.group_side_problems(df.where("g = 1"), "g", [1], None).collect()
    assert [(r.problem, r.group) for r in empty] == [("empty_side", "right")]


def test_single_group_goes_to_train(spark):
    df = frame(spark, [(1, "u"), (2, "u")], "sample_id int, g string")
    out = splits.sorted_group_partition(df, "g", 0.5, order="natural", single_group="train")
    assert {r.split for r in out.collect()} == {"train"}


@pytest.mark.parametrize("counts", [[1, 2, 3, 10, 25], [1], [2]])
@pytest.mark.parametrize("ratio", [0.5, 0.75, 0.9])
def test_stratified_counts(spark, counts, ratio):
    rows = [(f"s{l}-{i}", l) for l, n in enumerate(counts) for i in range(n)]
    df = frame(spark, rows, "sample_id string, label int")
    out = splits.stratified_train_val(df, "label", ratio, 7)
    got = {(r.label, r.split): r.n for r in out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label, n in enumerate(counts):
        want = 1 if n == 1 else max(1, min(n - 1, round(n * ratio)))
        assert got.get((label, "train"), 0) == want
        assert got.get((label, "val"), 0) == n - want


def test_stratified_does_not_depend_on_layout(spark):
    df = frame(spark, [(i, i % 3) for i in range(200)], "sample_id bigint, label bigint")
    runs = set()
    for parts in (1, 13):
        out = splits.stratified_train_val(df.repartition(parts), "label", 0.8, 5)
        runs.add(tuple(sorted((r.sample_id, r.split) for r in out.collect())))
    assert len(runs) == 1


def test_ensure_val_and_moved_test_row(spark):
    single = frame(spark, [(i, i, i) for i in range(4)], "sample_id bigint, label bigint, pos bigint")
    out = {r.label: r.split for r in splits.stratified_train_val(single, "label", 0.8, 1, ensure_val=True).collect()}
    assert out == {0: "train", 1: "train", 2: "train", 3: "val"}
    one = splits.stratified_train_val(single.where("label = 0"), "label", 0.8, 1, ensure_val=True)
    assert [r.split for r in one.collect()] == ["train"]
    pairs = frame(spark, [(10, 1, 5), (11, 2, 3), (12, 2, 4), (13, 1, 6)], "sample_id bigint, label bigint, pos bigint")
    moved = splits.stratified_trainval_test(pairs, "label", 0.1, 1).where("split = 'test'").collect()
    # sizes tie: the smaller label gives its first row
    assert [(r.label, r.pos) for r in moved] == [(1, 5)]


def test_declared_split_row_in_two_splits(spark):
    df = frame(spark, [(1, 3, 0), (2, 4, 0), (3, None, 0)], "sample_id int, user int, label int")
    contract = {"train": {"user": [3, 4]}, "test": {"user": None}}
    out = splits.declared_split(df, contract, "label", 0.5, 1).collect()
    by_id = {}
    for r in out:
        by_id.setdefault(r.sample_id, set()).add(r.split)
    assert "test" in by_id[1] and len(by_id[1]) == 2 and by_id[3] == {"test"}


def test_leakage_null_keys_and_tuples(spark):
    left = frame(spark, [(1, None, "x"), (2, 5, "y"), (3, 6, "x")], "id int, a int, b string")
    right = frame(spark, [(None, "x"), (6, "y")], "a int, b string")
    assert [(r.a, r.b) for r in leakage.leakage_keys(left, right, ["a", "b"]).collect()] == [(None, "x")]
    assert leakage.has_leakage(left, right, ["a"])
    by_tuple = {(r.field, r.value) for r in leakage.leakage_by_field(left, right, ["a", "b"]).collect()}
    by_field = {(r.field, r.value) for r in leakage.field_overlap(left, right, ["a", "b"]).collect()}
    assert by_tuple == {("b", "x")}
    assert by_field == {("a", "6"), ("b", "x"), ("b", "y")}
    assert [r.id for r in leakage.overlapping_rows(left, right, ["a", "b"]).collect()] == [1]
    with pytest.raises(ValueError, match="missing"):
        leakage.leakage_keys(left, right, ["zzz"])


def test_get_split_candidates(spark):
    df = frame(
        spark, [(1, {"fold": "val"}, "train"), (2, {"split": "val"}, "train"), (3, {"fold": "x", "split": "val"}, "val")],
        "sample_id int, partitions map<string,string>, split string",
    )
    pick = lambda *f: sorted(r.sample_id for r in manifest.get_split(df, "val", candidate_fields=f).collect())
    assert pick("fold", "split") == [1, 2]
    assert pick("split") == [2, 3]
    assert pick("absent", "split") == [2, 3]
    with pytest.raises(ValueError, match="fold"):
        manifest.require_split(df, "nope")


def test_annotate_keeps_other_partitions(spark):
    df = frame(spark, [(1, {"split": "old", "fold": "3"}), (2, None)], "sample_id int, partitions map<string,string>")
    out = {r.sample_id: r.partitions for r in manifest.annotate_split(df, "val").collect()}
    assert out == {1: {"fold": "3", "split": "val"}, 2: {"split": "val"}}


def test_label_helpers(spark):
    df = frame(spark, [(0, "b"), (1, "a"), (2, "b")], "pos bigint, target string")
    assert [r.label for r in labels.encode_first_appearance(df, "target").orderBy("pos").collect()] == [0, 1, 0]
    ints = frame(spark, [(0, 7), (1, 3)], "pos bigint, target int")
    assert [r.label for r in labels.encode_first_appearance(ints, "target").orderBy("pos").collect()] == [7, 3]
    mapped = labels.encode_sorted(df, "target", labels.invert_label_map({4: "a", 9: "b"}))
    assert [r.label for r in mapped.orderBy("pos").collect()] == [9, 4, 9]


def test_index_ranges(spark):
    df = frame(spark, [("1:3, 8,non",), ("non",), ("",), ("5:4",)], "s string")
    got = [r.x for r in df.select(catalogue.parse_index_ranges(F.col("s")).alias("x")).collect()]
    assert got == [[1, 2, 3, 8], [], [], []]


def test_split_mapping_and_required(spark):
    df = frame(spark, [(i, "train" if i % 2 else "val") for i in range(20)], "pos bigint, split string")
    out = manifest.split_mapping(df, max_per_split=3).orderBy("pos").collect()
    assert [(r.pos) for r in out] == [0, 1, 2, 3, 4, 5]
    assert manifest.missing_splits(df, ["train", "test"]) == ["test"]


def test_weighted_resample_follows_weights(spark):
    df = frame(spark, [(i, 0.0 if i == 0 else 700.0 if i == 1 else 0.3) for i in range(1000)], "pos bigint, w double")
    out = sampling.weighted_resample(df, "w", 3).groupBy("pos").count().collect()
    counts = {r.pos: r["count"] for r in out}
    assert sum(counts.values()) == 1000 and 0 not in counts
    assert 600 < counts[1] < 800


def test_sample_ids(spark):
    df = frame(spark, [(0, "a"), (1, "b")], "pos bigint, record_id string")
    assert [r.resolved_id for r in manifest.resolve_sample_ids(df).orderBy("pos").collect()] == ["a", "b"]
    none = df.drop("record_id")
    assert [r.resolved_id for r in manifest.resolve_sample_ids(none).orderBy("pos").collect()] == ["sample-000000", "sample-000001"]


def test_rows_without_a_side_stay_visible(spark):
    df = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)], "sample_id int, g string")
    got = {r.sample_id: r.side for r in splits.group_split(df, "g", left_values=["a"], right_values=["b"]).collect()}
    assert got == {1: "left", 2: "right", 3: None, 4: None}
    one = {r.sample_id: r.side for r in splits.group_split(df, "g", left_values=["a"]).collect()}
    assert one == {1: "left", 2: "right", 3: "right", 4: None}
    with pytest.raises(ValueError, match="uncovered c"):
        splits.require_group_sides(df, "g", ["a"], ["b"])
    splits.require_group_sides(df.where("sample_id < 3"), "g", ["a"], ["b"])


def test_required_splits(spark):
    df = frame(spark, [(1, "train"), (2, None), (3, "other")], "sample_id int, split string")
    assert [(r.problem, r.detail) for r in splits.split_problems(df).collect()] == [("missing_split", "test")]
    with pytest.raises(ValueError, match="test"):
        splits.require_splits(df)
    splits.require_splits(df, required=("train",))


def test_labels_without_coordinates_stay(spark):
    from cellwave.operators import labels

    df = frame(spark, [(1, 0), (2, 7)], "sample_id int, label int")
    spots = frame(spark, [(0, [1.0, 2.0])], "label int, position array<double>")
    got = {r.sample_id: r.position for r in labels.join_coordinates(df, spots, "label").collect()}
    assert got == {1: [1.0, 2.0], 2: None}
    with pytest.raises(ValueError, match="missing_coordinate 7"):
        labels.require_coordinates(df, spots, "label", "position")


def test_a_row_of_nearly_all_weight_loses_no_draw(spark):
    from cellwave.operators import sampling

    n = 40000
    df = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") == 700, 1e9).otherwise(0.1).alias("w"))
    got = sampling.weighted_resample(df, "w", 5, chunk=1000)
    rows, draws = got.agg(F.count("*"), F.count_distinct("draw")).first()
    assert rows == draws == n
    assert got.where("pos = 700").count() > 0.999 * n


def test_rows_without_a_label_stay(spark):
    rows = [(0, "b", 1), (1, None, 2), (2, "a", 3), (3, None, 4), (4, "b", 5)]
    df = spark.createDataFrame(rows, "pos long, target string, x int").repartition(3)
    assert [r.label for r in labels.encode_first_appearance(df, "target").orderBy("pos").collect()] == [0, None, 1, None, 0]
    assert [r.label for r in labels.encode_sorted(df, "target").orderBy("pos").collect()] == [1, None, 0, None, 1]
    head = sampling.balanced_head(df, "target", 4)
    assert [r.pos for r in head.collect()] == [1, 2, 0, 3]
    made = splits.dataset_from_samples(df.withColumn("sample_id", F.concat(F.lit("s"), "pos")), sample="sample_id")
    assert sorted(r.pos for r in made.collect()) == [0, 1, 2, 3, 4] and made.where("split is null").isEmpty()
