"""Order-dependent building blocks that never sort one key in one task.

A key may hold a large share of all rows, so each helper orders rows inside
``(key, bucket)`` where the bucket is monotone in the order, and carries the
state between buckets through a small table of per-bucket totals.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwave.functions.columns import int_pow2_bucket, null_safe


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="cellwave-")
    return _own[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs re-read it after executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors are lost."""
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def global_ordinal(
    df: DataFrame, order: list, name: str = "pos", partitions: int | None = None
) -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in a total order; also return n.

    Range partitioning spreads the sort; counts per partition are joined back. The order columns must be a total order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    pinned = cut_lineage(ranged)
    part = F.shiftright("_row", 33).cast("int")
    pinned = pinned.withColumn("_part", part)
    sizes = pinned.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = pinned.join(starts, "_part").withColumn(name, F.col("_start") + inside)
    return placed.drop("_row", "_part", "_start"), pinned.count()


def bucketed_ordinal(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "pos") -> DataFrame:
    """Number rows 0..n-1 within each key.

    ``bucket`` must not decrease along ``order``; it splits the sort of every key.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    numbered = null_safe(rows.withColumn("_inside", inside), starts, [*keys, "_bucket"])
    return numbered.withColumn(name, F.col("_start") + F.col("_inside") - 1).drop("_bucket", "_inside", "_start")


def first_rows_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    take: Callable[[Column], Column],
    name: str,
) -> DataFrame:
    """Mark the first ``take(n)`` rows of each key, n being the key's row count.

    Rows are not sorted whole: bucket counts locate the one bucket per key that
    holds the last taken row, only that bucket is ranked, and every row is
    compared with the row found there. The order columns must be a total order
    and ``bucket`` must not decrease along it. The table of last rows is joined,
    which Spark broadcasts where it is small.
    """
    place = F.struct(*order)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = sizes.select(
        *keys, "_bucket", "_size", F.sum("_size").over(upto).alias("_upto"),
        take(F.sum("_size").over(by_key)).alias("_take"),
    )
    edges = edges.where((F.col("_take") <= F.col("_upto")) & (F.col("_take") > F.col("_upto") - F.col("_size")))
    edges = edges.select(*keys, "_bucket", (F.col("_take") - F.col("_upto") + F.col("_size")).alias("_rank"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    narrow = rows.select(*dict.fromkeys([*keys, *order]), "_bucket")
    near = null_safe(narrow, edges, [*keys, "_bucket"])
    last = near.withColumn("_inside", inside).where(F.col("_inside") == F.col("_rank"))
    marked = null_safe(df, last.select(*keys, place.alias("_last")), keys, "left")
    return marked.withColumn(name, F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_last")


def bucketed_lag(df: DataFrame, keys: list[str], order: str, bucket: Column, value: str, name: str) -> DataFrame:
    """Previous row's value within each key, carried across bucket borders."""
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        *keys,
        "_bucket",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"),
    )
    marked = rows.withColumn("_inside", F.row_number().over(inside)).withColumn(
        "_lagged", F.lag(value).over(inside)
    )
    return (
        null_safe(marked, carried, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_inside") == 1, F.col("_carried")).otherwise(F.col("_lagged")))
        .drop("_bucket", "_inside", "_lagged", "_carried")
    )


def with_halo(df: DataFrame, pos: str, chunk: int, before: int, after: int) -> DataFrame:
    """Copy each row to every chunk whose frame needs it.

    Adds ``_chunk`` and ``_own`` (true on the one copy the row belongs to).
    """
    p = F.col(pos)
    first = F.greatest(F.lit(0), F.floor((p - after) / F.lit(chunk)))
    last = F.floor((p + before) / F.lit(chunk))
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == F.floor(p / F.lit(chunk))
    )


def running_sum(
    df: DataFrame, keys: list[str], pos: str, value: Column, name: str, chunk: int = 65536
) -> DataFrame:
    """Inclusive prefix sum along ``pos`` within each key, chunk by chunk."""
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk))).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_sum"))
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_start")
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe(rows.withColumn("_run", F.sum("_v").over(inside)), starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.coalesce(F.col("_run"), F.lit(0.0)))
        .drop("_chunk", "_v", "_run", "_start")
    )


def median(df: DataFrame, keys: list[str], value: str, name: str, average: bool = False) -> DataFrame:
    """Exact lower (or averaging) median of a positive column per key.

    Equal values collapse first, then cumulative bucket counts find the bucket
    that holds the middle rank, so no key is sorted whole.
    """
    counts = (
        df.groupBy(*keys, value)
        .agg(F.count("*").alias("_c"))
        .withColumn("_bucket", int_pow2_bucket(F.col(value)))
    )
    per_bucket = counts.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_size"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_size").over(by_key)
    ranks = [F.floor((total - 1) / 2)] + ([F.floor(total / 2)] if average else [])
    target = (
        per_bucket.withColumn("_upto", F.sum("_size").over(upto))
        .withColumn("_ranks", F.array(*ranks))
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_size")))
        .select(*keys, "_bucket", (F.col("_upto") - F.col("_size")).alias("_start"), "_rank")
    )
    # both middle ranks of one key may share a bucket
    wanted = target.groupBy(*keys, "_bucket", "_start").agg(F.collect_list("_rank").alias("_ranks"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cumulative = null_safe(counts, wanted, [*keys, "_bucket"]).withColumn(
        "_cum", F.col("_start") + F.sum("_c").over(inside)
    )
    hits = cumulative.select(*keys, value, "_cum", "_c", F.explode("_ranks").alias("_rank")).where(
        (F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_c"))
    )
    return hits.groupBy(*keys).agg(F.avg(value).alias(name))
