"""Datasets written by split and in buckets, and digests that find what differs."""

from pyspark.sql import functions as F

from cellwave.operators import artifacts
from cellwave.sources import sinks


def rows(spark, count=300):
    split = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "val").otherwise("train")
    return spark.range(count).select(F.col("id").alias("sample_id"), split.alias("split"), (F.col("id") * 2).alias("x"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splits_are_read_from_their_folder(spark, tmp_path):
    place = str(tmp_path / "set")
    sinks.write_splits(rows(spark), place, files=3)
    for name in ("train", "val", None):
        got = sinks.read_split(spark, place, name)
        want = rows(spark).where(F.col("split").eqNullSafe(F.lit(name)))
        assert sorted(r.sample_id for r in got.collect()) == sorted(r.sample_id for r in want.collect())
        plan = plan_of(got)
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(sinks.read_split(spark, place, "train").inputFiles()) <= 3


def test_a_split_is_replaced_alone(spark, tmp_path):
    place = str(tmp_path / "set")
    sinks.write_splits(rows(spark), place)
    again = spark.range(5).select(F.col("id").alias("sample_id"), F.lit("val").alias("split"), F.lit(0).cast("long").alias("x"))
    sinks.write_splits(again, place)
    assert sinks.read_split(spark, place, "val").count() == 5
    assert sinks.read_split(spark, place, "train").count() == rows(spark).where("split = 'train'").count()


def test_buckets_meet_without_an_exchange(spark):
    left, right = rows(spark), rows(spark, 200).select("sample_id", (F.col("x") + 1).alias("y"))
    try:
        sinks.write_bucketed(left, "sink_left", buckets=4)
        sinks.write_bucketed(right, "sink_right", buckets=4)
        both = spark.table("sink_left").join(spark.table("sink_right").hint("merge"), "sample_id")
        out = both.groupBy("sample_id").agg(F.sum("y").alias("y"))
        assert "Exchange" not in plan_of(out) and "SortMergeJoin" in plan_of(out)
        assert out.count() == 200
        assert len(spark.table("sink_left").inputFiles()) == 4
    finally:
        for name in ("sink_left", "sink_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_trees_find_what_differs(spark):
    old = rows(spark, 1000)
    new = old.where("sample_id not in (5, 7)").withColumn("x", F.when(F.col("sample_id") == 11, -1).otherwise(F.col("x")))
    new = new.unionByName(spark.range(2000, 2002).select(F.col("id").alias("sample_id"), F.lit("val").alias("split"), F.lit(1).cast("long").alias("x")))
    a, b = artifacts.merkle_tree(old, "sample_id"), artifacts.merkle_tree(new.repartition(7), "sample_id")
    got = {(r.sample_id, r.change) for r in artifacts.digest_diff(old, new, "sample_id", a, b).collect()}
    assert got == {(5, "removed"), (7, "removed"), (11, "changed"), (2000, "added"), (2001, "added")}
    assert artifacts.differing_buckets(a, b).count() == 5
    same = artifacts.merkle_tree(old.orderBy(F.desc("x")), "sample_id")
    assert artifacts.differing_buckets(a, same).isEmpty() and artifacts.digest_diff(old, old, "sample_id", a, same).isEmpty()
    root = a.where("level = 0").first()
    assert root.n == 1000 and root.digest != b.where("level = 0").first().digest


def test_empty_sides(spark):
    none, old = rows(spark, 0), rows(spark, 3)
    a, b = artifacts.merkle_tree(none, "sample_id"), artifacts.merkle_tree(old, "sample_id")
    assert {r.change for r in artifacts.digest_diff(none, old, "sample_id", a, b).collect()} == {"added"}
    assert {r.change for r in artifacts.digest_diff(old, none, "sample_id", b, a).collect()} == {"removed"}
