"""Datasets on disk by split, by key part, and in buckets of the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, columns: list[str], key: str = "sample_id", files: int = 16) -> None:
    """One folder for each value of ``columns``; folders that are written again are replaced, others stay.

    A value's rows are dealt to at most ``files`` files by ``key``, so that a split of most rows is no single task.
    """
    salt = F.pmod(F.xxhash64(key), F.lit(files))
    rows = df.repartition(*columns, salt)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", key: str = "sample_id", files: int = 16) -> None:
    """The dataset by split; rows without one go to a folder of their own."""
    write_partitioned(df, path, [split], key, files)


def read_split(spark: SparkSession, path: str, name: str | None, split: str = "split") -> DataFrame:
    """The rows of one split (None: those without one), from its folder alone."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(split).eqNullSafe(F.lit(name)))


def write_bucketed(df: DataFrame, table: str, key: str = "sample_id", buckets: int = 64) -> None:
    """A table in ``buckets`` sorted buckets of ``key``, one file each: joins and groups by the key need no exchange.

    Tables that are to meet must have the same number of buckets.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
