"""Overlap between two sides of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import null_safe


def _fields(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> list[str]:
    names = [f.strip() for f in fields]
    if not names or not all(names):
        raise ValueError("leakage fields must be non-empty strings")
    if len(set(names)) != len(names):
        raise ValueError(f"leakage fields must be unique: {names}")
    for side, df in (("left", left), ("right", right)):
        absent = [f for f in names if f not in df.columns]
        if absent:
            raise ValueError(f"fields {absent} missing on the {side} side; it has {df.columns}")
    return names


def leakage_keys(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct key tuples on both sides; null equals null."""
    names = _fields(left, right, fields)
    return left.select(*names).intersect(right.select(*names))


def has_leakage(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> bool:
    return not leakage_keys(left, right, fields).isEmpty()


def _unpivoted(df: DataFrame, names: list[str]) -> DataFrame:
    entries = F.array(
        *(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names)
    )
    return (
        df.select(F.explode(entries).alias("e"))
        .select("e.field", "e.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def leakage_by_field(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field values that occur in an overlapping key tuple; nulls dropped."""
    return _unpivoted(leakage_keys(left, right, fields), list(fields))


def overlapping_rows(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Left rows whose key tuple also occurs on the right."""
    names = _fields(left, right, fields)
    return null_safe(left, right.select(*names).distinct(), names, "left_semi")


def field_overlap(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field, the values both sides hold, each field on its own."""
    names = _fields(left, right, fields)
    return _unpivoted(left, names).join(
        _unpivoted(right, names), on=["field", "value"], how="left_semi"
    )
