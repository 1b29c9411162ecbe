"""Label encoding and label-driven joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.operators.ordinal import global_ordinal


def encode_first_appearance(df: DataFrame, target: str, pos: str = "pos") -> DataFrame:
    """Add ``label``: strings are numbered by first appearance, integers kept; a null target has a null label."""
    if dict(df.dtypes)[target] != "string":
        return df.withColumn("label", F.col(target).cast("bigint"))
    firsts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.min(pos).alias("_first"))
    codes, _ = global_ordinal(firsts, ["_first"], name="label")
    return df.join(codes.select(target, "label"), on=target, how="left")


def encode_sorted(
    df: DataFrame, target: str, mapping: dict[str, int] | None = None
) -> DataFrame:
    """Add ``label`` by sorted unique value; an explicit map wins. A null target has a null label."""
    if mapping:
        pairs = [p for k, v in mapping.items() for p in (F.lit(k), F.lit(int(v)))]
        code = F.create_map(*pairs)[F.col(target)].cast("bigint")
        return df.withColumn("label", code)
    codes, _ = global_ordinal(df.where(F.col(target).isNotNull()).select(target).distinct(), [target], name="label")
    return df.join(codes, on=target, how="left")


def invert_label_map(idx_to_label: dict) -> dict[str, int]:
    return {str(v): int(k) for k, v in idx_to_label.items()}


def remap_labels(df: DataFrame, label: str, mapping: dict[int, int]) -> DataFrame:
    """Merge classes; an unmapped id keeps its value."""
    if not mapping:
        return df
    pairs = [F.lit(int(x)).cast("bigint") for kv in mapping.items() for x in kv]
    mapped = F.try_element_at(F.create_map(*pairs), F.col(label).cast("bigint"))
    return df.withColumn(label, F.coalesce(mapped, F.col(label).cast("bigint")))


def join_coordinates(df: DataFrame, coordinates: DataFrame, label: str) -> DataFrame:
    """Attach the coordinate list of each row's label; rows whose label has none keep a null one."""
    return df.join(coordinates, on=label, how="left")


def require_coordinates(df: DataFrame, coordinates: DataFrame, label: str, position: str) -> None:
    """Raise when a label has no coordinate or coordinates differ in length."""
    found = coordinate_problems(df, coordinates, label, position).take(20)
    if found:
        raise ValueError("label coordinates: " + "; ".join(f"{r['problem']} {r['detail']}" for r in found))


def coordinate_problems(df: DataFrame, coordinates: DataFrame, label: str, position: str) -> DataFrame:
    """Labels without coordinates, and dimensionalities when more than one occurs."""
    missing = (
        df.select(label)
        .distinct()
        .join(coordinates, on=label, how="left_anti")
        .select(F.lit("missing_coordinate").alias("problem"), F.col(label).cast("string").alias("detail"))
    )
    used = coordinates.join(df.select(label).distinct(), on=label, how="left_semi")
    sizes = used.agg(F.collect_set(F.size(position)).alias("s"))
    mixed = sizes.where(F.size("s") > 1).select(
        F.lit("mixed_dimensions").alias("problem"),
        F.array_join(F.array_sort("s"), ",").alias("detail"),
    )
    return missing.unionByName(mixed)


def label_histogram(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))


def split_manifest(
    df: DataFrame, splits: Sequence[str], split: str = "split", sample: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """Counts per split, and the sample ids as a table rather than a list."""
    ids = df.where(F.col(split).isin(*splits)).select(split, sample)
    return ids.groupBy(split).agg(F.count("*").alias("n")), ids
