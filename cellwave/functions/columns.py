"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
SPEED_OF_LIGHT = 299_792_458.0
SPEED_OF_SOUND = 343.0


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null, keeping the left copy of each key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_r_{k}" for k in keys))


def half_even(x: Column) -> Column:
    """Round to an integer, ties to even."""
    return F.bround(x, 0).cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high),
                      F.lit(low) if not isinstance(low, Column) else low)


def floor_mod(x: Column, period: float) -> Column:
    """Modulo with the sign of the divisor, as float remainder."""
    return x - F.floor(x / F.lit(period)) * F.lit(period)


def shuffle_key(sample: str, seed: int, tag: str = "") -> Column:
    """A seeded order key that any engine can recompute."""
    return F.md5(F.concat(F.lit(f"{tag}{seed}|"), F.col(sample).cast("string")))


def seconds(ts: str) -> Column:
    """Timestamp column to float seconds at microsecond precision."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def int_pow2_bucket(x: Column, per_octave: int = 16) -> Column:
    """A bucket number that never decreases as a positive value grows."""
    return F.floor(F.log2(x) * F.lit(float(per_octave)))
