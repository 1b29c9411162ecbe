"""Sample order, resampling and batching of manifest rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwave.functions.columns import null_safe, shuffle_key
from cellwave.operators.ordinal import bucketed_lag, bucketed_ordinal, running_sum

CELL_STEP = 1024
PART_ROWS = 1 << 16
MOST_PARTS = 1 << 16


def shuffled_order(df: DataFrame, sample: str, seed: int, name: str = "order") -> DataFrame:
    """Position of every row in one seeded shuffle.

    Hash prefixes cut the order into 65536 even ranges that sort in parallel.
    """
    hashed = df.withColumn("_hash", shuffle_key(sample, seed))
    return bucketed_ordinal(
        hashed, [], ["_hash", sample], F.substring("_hash", 1, 4), name
    ).drop("_hash")


def uniform_draw(id_column: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the seed and the row id (52 bits)."""
    digest = shuffle_key(id_column, seed, "draw")
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(16.0**13)


def weighted_resample(
    df: DataFrame, weight: str, seed: int, pos: str = "pos", chunk: int = 1 << 20
) -> DataFrame:
    """As many draws as rows, with replacement, in proportion to ``weight``.

    ``pos`` numbers the rows 0..n-1. Weight space is cut into even cells; each
    row is listed in the cells its interval touches and each draw falls in one,
    so a cell sees a handful of draws whatever the weights are. An interval
    begins where the one before it ends, to the last bit, so no draw is lost.
    """
    weighed = df.where(F.col(weight) > 0)
    placed = running_sum(weighed, [], pos, F.col(weight), "_upto", chunk)
    placed = bucketed_lag(placed, [], pos, F.floor(F.col(pos) / F.lit(chunk)), "_upto", "_from")
    total = placed.agg(F.max("_upto")).scalar()
    cells = F.greatest(F.lit(1.0), F.ceil(df.agg(F.count("*")).scalar() / F.lit(16.0)))
    low = F.coalesce(F.col("_from"), F.lit(0.0)) / total
    spans = placed.withColumns({"_low": low, "_high": F.col("_upto") / total})
    first, last = F.floor(F.col("_low") * cells), F.floor(F.col("_high") * cells)
    # two steps, so that a row of most of the weight makes no long array
    step = F.lit(CELL_STEP)
    spans = spans.withColumn("_outer", F.explode(F.sequence(F.floor(first / step), F.floor(last / step))))
    inner = F.sequence(F.greatest(first, F.col("_outer") * step), F.least(last, F.col("_outer") * step + step - 1))
    spans = spans.withColumn("_cell", F.explode(inner)).drop("_outer", "_from")
    draws = (
        df.select(F.col(pos).alias("draw"))
        .withColumn("_u", uniform_draw("draw", seed))
        .withColumn("_cell", F.floor(F.col("_u") * cells))
    )
    return (
        draws.join(spans, on="_cell")
        .where((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
        .drop("_cell", "_u", "_low", "_high", "_upto")
    )


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables: column ``k`` keeps itself below ``keep[k]`` and goes to ``other[k]`` above."""
    n = len(weights)
    keep, other = weights * (n / weights.sum()), np.arange(n)
    small, large = list(np.flatnonzero(keep < 1)[::-1]), list(np.flatnonzero(keep >= 1)[::-1])
    while small and large:
        low, high = small.pop(), large[-1]
        other[low] = high
        keep[high] -= 1 - keep[low]
        if keep[high] < 1:
            small.append(large.pop())
    keep[small + large] = 1.0  # what rounding left over
    return keep, other


def alias_resample(df: DataFrame, weight: str, seed: int, pos: str = "pos", part_rows: int = PART_ROWS) -> DataFrame:
    """As many draws as rows, with replacement, in proportion to ``weight``, numbered by ``draw``.

    Rows are dealt to parts. How many draws each part gets is one multinomial draw over the parts' weights (of which
    there are at most ``MOST_PARTS``); inside a part draws come from Walker's table, at one step each whatever the
    weights are. A part of much weight is drawn in shares of ``part_rows`` draws, each by a task that makes the same
    table. ``pos`` names each row; rows of null, zero or negative weight are never drawn. The same seed and rows give
    the same draws however they are partitioned.
    """
    spark = df.sparkSession
    weighed = df.where((F.col(weight) > 0) & F.col(pos).isNotNull())
    total, rows = df.count(), weighed.count()
    if not rows:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    parts = max(min(-(-rows // part_rows), MOST_PARTS), 1)
    weighed = weighed.withColumn("_part", F.pmod(F.xxhash64(pos, F.lit(seed)), F.lit(parts)))
    sums = weighed.groupBy("_part").agg(F.sum(F.col(weight).cast("double")).alias("w")).orderBy("_part").toArrow()
    share = sums["w"].to_numpy() / sums["w"].to_numpy().sum()
    draws = np.random.default_rng([seed, parts]).multinomial(total, share)
    shares = -(-draws // part_rows)
    part = np.repeat(sums["_part"].to_numpy(), shares)
    number = np.arange(len(part)) - np.repeat(np.cumsum(shares) - shares, shares)
    count = np.minimum(part_rows, np.repeat(draws, shares) - number * part_rows)
    plan = pa.table({"_part": part, "_share": number, "_count": count, "_first": np.cumsum(count) - count})
    # a row a share: two for each part at most, plus one for each ``part_rows`` draws
    spread = weighed.join(F.broadcast(spark.createDataFrame(plan)), "_part")
    names = df.columns
    at = names.index(weight)

    def drawn(table: pa.Table) -> pa.Table:
        table = table.sort_by([(pos, "ascending")])
        keep, other = alias_table(table.column(at).to_numpy().astype(float))
        part, number, count, first = (table[c][0].as_py() for c in ("_part", "_share", "_count", "_first"))
        pick = np.random.default_rng([seed, part, number])
        column = pick.integers(0, len(keep), count)
        chosen = np.where(pick.random(count) < keep[column], column, other[column])
        return table.select(names).take(pa.array(chosen)).append_column("draw", pa.array(first + np.arange(count)))

    schema = T.StructType([*df.schema.fields, T.StructField("draw", T.LongType())])
    columns = [*names, "_part", "_share", "_count", "_first"]
    return spread.select(*columns).groupBy("_part", "_share").applyInArrow(drawn, schema)


def weight_count_problem(df: DataFrame, weight: str) -> DataFrame:
    """One row when some rows have no weight."""
    return df.agg(
        F.count("*").alias("rows"), F.count(weight).alias("weights")
    ).where(F.col("rows") != F.col("weights"))


def batches(df: DataFrame, size: int, order: str, values: Sequence[str]) -> DataFrame:
    """Stack rows into batches of ``size`` in the given 0-based order."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    batch = F.floor(F.col(order) / F.lit(size)).alias("batch")
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    stacked = df.groupBy(batch).agg(rows.alias("_rows"))
    return stacked.select(
        "batch", F.size("_rows").alias("n"), *(F.col(f"_rows.{v}").alias(v) for v in values)
    )


def structured_batches(
    df: DataFrame, size: int, order: str, keys: Sequence[str], target: str = "target"
) -> DataFrame:
    """Stack a map of targets key by key; keys come out sorted."""
    names = sorted(keys)
    flat = df.select(order, *(F.col(target).getItem(k).alias(f"_t{i}") for i, k in enumerate(names)))
    stacked = batches(flat, size, order, [f"_t{i}" for i in range(len(names))])
    return stacked.withColumnsRenamed({f"_t{i}": k for i, k in enumerate(names)})


def key_set_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows per distinct target key set; more than one row breaks a structured batch."""
    keys = F.array_join(F.array_sort(F.map_keys(target)), ",")
    return df.groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


def balanced_head(df: DataFrame, label: str, limit: int, pos: str = "pos") -> DataFrame:
    """The first row of every label (null is one, and the first), then other rows by label and position, up to a limit."""
    firsts = df.groupBy(label).agg(F.min(pos).alias("_first"))
    rest = F.when(F.col(pos) == F.col("_first"), 0).otherwise(1)
    return (
        null_safe(df, firsts, [label])
        .withColumn("_rest", rest)
        .orderBy("_rest", label, pos)
        .limit(limit)
        .drop("_rest", "_first")
    )
