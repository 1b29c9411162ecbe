"""Packet-stream operators and data-quality audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import null_safe
from cellwave.model import KEY
from cellwave.operators.ordinal import bucketed_lag, bucketed_ordinal, median


@dataclass(frozen=True)
class Binding:
    """Raw column -> canonical column, through a converter and a linear scale."""

    raw: str
    canonical: str
    via: Callable[[Column], Column] | None = None
    scale: float | None = None


def apply_binding(
    df: DataFrame, bindings: Sequence[Binding], known: Sequence[str] = (), keep_unmapped: bool = False
) -> DataFrame:
    """Rename, convert and scale raw columns; others drop unless kept or canonical."""
    kinds, by_raw = dict(df.dtypes), {b.raw: b for b in bindings}
    targets = [b.canonical for b in bindings]
    if len(set(targets)) != len(targets):
        raise ValueError("two raw fields bind to one canonical name")
    out = []
    for name in df.columns:
        b = by_raw.get(name)
        if b is None:
            if keep_unmapped or name in known:
                out.append(F.col(name))
            continue
        value = b.via(F.col(name)) if b.via else F.col(name)
        if b.scale is not None:
            if b.via is None and kinds[name] == "boolean":
                raise ValueError(f"boolean field {name!r} cannot be scaled")
            value = value * F.lit(b.scale)
        out.append(value.alias(b.canonical))
    return df.select(*out)


def capture_problems(manifest: DataFrame, listing: DataFrame, path: str = "path", code: str = "BB") -> DataFrame:
    """Manifest rows with ``reason``: missing, too short, bad header, or null when valid.

    ``listing(path, length, head)`` holds each file's first three bytes. A listed file of unknown length is not missing.
    """
    files = listing.select(path, "length", "head", F.lit(True).alias("_listed"))
    size = F.conv(F.hex(F.substring("head", 1, 2)), 16, 10).cast("bigint")
    reason = (
        F.when(F.col("_listed").isNull(), "missing")
        .when(F.col("length") < 3, "too_short")
        .when(F.hex(F.substring("head", 3, 1)) != code, "bad_code")
        .when(F.col("length") - 3 < size - 1, "incomplete_packet")
    )
    return manifest.join(files, on=path, how="left").withColumn("reason", reason).drop("length", "head", "_listed")


def coordinate_length_problems(cells: DataFrame, coords: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``(sample_id, axis, cells, coords)`` where a coordinate count differs from the axis length."""
    lengths = cells.groupBy(KEY).agg(*((F.max(a) + 1).cast("bigint").alias(a) for a in axes))
    entries = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("cells")) for a in axes))
    long = lengths.select(KEY, F.explode(entries).alias("e")).select(KEY, "e.axis", "e.cells")
    counts = coords.groupBy(KEY, "axis").agg(F.count("*").alias("coords"))
    # an axis without coordinates is fine; coordinates without an axis are not
    return counts.join(long, on=[KEY, "axis"], how="left").where(
        ~F.col("cells").eqNullSafe(F.col("coords"))
    ).select(KEY, "axis", "cells", "coords")


def metadata_problems(
    samples: DataFrame,
    physical: Sequence[str] = (),
    coord_units: dict[str, str] | None = None,
    extra_fields: Sequence[str] = (),
    coords: DataFrame | None = None,
) -> DataFrame:
    """One row per violated requirement: ``(sample_id, kind, field)``."""

    def finding(bad: Column, kind: str, field: str) -> Column:
        return F.when(bad, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field")))

    checks = []
    for f in physical:
        value = F.col(f).cast("double") if f in samples.columns else F.lit(None).cast("double")
        checks.append(finding(value.isNull() | (value == 0.0) | F.isnan(value), "physical", f))
    for f in extra_fields:
        checks.append(finding(~F.coalesce(F.map_contains_key("extra", f), F.lit(False)), "extra", f))
    rows = samples
    for axis, unit in (coord_units or {}).items():
        held = coords.where(F.col("axis") == axis).groupBy(KEY).agg(F.min("unit").alias(f"_unit_{axis}"))
        rows = rows.join(held, on=KEY, how="left")
        checks.append(finding(~F.col(f"_unit_{axis}").eqNullSafe(F.lit(unit)), "coord_unit", axis))
    found = rows.select(KEY, F.explode(F.array_compact(F.array(*checks))).alias("p"))
    return found.select(KEY, "p.kind", "p.field")


def merge_packets(packets: DataFrame, capture: str, order: str, ts: str, bucket: Column) -> DataFrame:
    """Packets as a time axis: ``time`` index, ``time_s`` since the first packet.

    The first packet in order gives the origin. ``bucket`` must not decrease
    along ``order``.
    """
    first = packets.groupBy(capture).agg(F.min_by(ts, order).alias("_t0"), F.count("*").alias("_n"))
    indexed = bucketed_ordinal(packets, [capture], [order], bucket, "time")
    return (
        indexed.join(first.where("_n >= 2"), on=capture)
        .withColumn("time_s", F.col(ts) - F.col("_t0"))
        .drop("_t0", "_n")
    )


def short_captures(packets: DataFrame, capture: str) -> DataFrame:
    """Captures with fewer than two packets, which cannot be merged."""
    return packets.groupBy(capture).agg(F.count("*").alias("packets")).where("packets < 2")


def positive_steps(packets: DataFrame, capture: str, order: str, ts: str, bucket: Column) -> DataFrame:
    """Positive time steps ``(capture, step)`` between neighbouring packets."""
    lagged = bucketed_lag(packets.select(capture, order, F.col(ts).alias("_ts")), [capture], order, bucket, "_ts", "_prev")
    return lagged.select(capture, (F.col("_ts") - F.col("_prev")).alias("step")).where("step > 0")


def sample_rates(packets: DataFrame, capture: str, order: str, ts: str, bucket: Column) -> DataFrame:
    """1 / lower median of the positive steps; null when a capture has none."""
    steps = positive_steps(packets, capture, order, ts, bucket)
    rates = median(steps, [capture], "step", "_step").select(capture, (1.0 / F.col("_step")).alias("sample_rate"))
    return packets.select(capture).distinct().join(rates, on=capture, how="left")


def resolved_sample_rates(samples: DataFrame, coords: DataFrame, bucket: Column) -> DataFrame:
    """Declared rate if finite and positive, else 1 / median step of the time coordinate.

    Null marks a sample with neither.
    """
    time = coords.where(F.col("axis") == "time")
    steps = positive_steps(time, KEY, "idx", "value", bucket)
    derived = median(steps, [KEY], "step", "_step", average=True)
    rate = F.col("sample_rate").cast("double")
    usable = F.when((rate > 0) & (rate < float("inf")) & ~F.isnan(rate), rate)
    return samples.join(derived, on=KEY, how="left").select(
        KEY, F.coalesce(usable, 1.0 / F.col("_step")).alias("sample_rate")
    )


def probe_sample_rate(rates: DataFrame, pos: str, first: int = 10) -> DataFrame:
    """Mean rate of the first captures."""
    return rates.where(F.col(pos) < first).agg(F.avg("sample_rate").alias("estimated_rate"))


def select_packet_class(
    packets: DataFrame, capture: str, order: str, signature: Sequence[str], **filters
) -> DataFrame:
    """Packets with the exact signature of the first packet that passes the filters."""
    wanted = {k: v for k, v in filters.items() if v is not None}
    if not wanted:
        return packets
    passing = packets
    for field, value in wanted.items():
        passing = passing.where(F.col(field) == F.lit(value))
    chosen = passing.groupBy(capture).agg(F.min_by(F.struct(*signature), order).alias("_sig"))
    keys = chosen.select(capture, *(F.col(f"_sig.{s}").alias(s) for s in signature))
    return null_safe(packets, keys, [capture, *signature], "left_semi")


def shape_counts(packets: DataFrame, capture: str, shape: Sequence[str]) -> DataFrame:
    return packets.groupBy(capture, *shape).agg(F.count("*").alias("packets"))


def mixed_shapes(packets: DataFrame, capture: str, shape: Sequence[str]) -> DataFrame:
    """Shape counts of captures that hold more than one payload shape."""
    counts = shape_counts(packets, capture, shape)
    mixed = counts.groupBy(capture).agg(F.count("*").alias("_n")).where("_n > 1").select(capture)
    return counts.join(mixed, on=capture, how="left_semi")


def dominant_shape(packets: DataFrame, capture: str, shape: Sequence[str]) -> DataFrame:
    """The most frequent shape per capture (largest shape wins a tie) and the packets it drops."""
    counts = shape_counts(packets, capture, shape)
    best = F.max(F.struct("packets", *shape)).alias("_best")
    return counts.groupBy(capture).agg(best, F.sum("packets").alias("_all")).select(
        capture, *(F.col(f"_best.{s}").alias(s) for s in shape), (F.col("_all") - F.col("_best.packets")).alias("dropped")
    )


def keep_dominant_shape(packets: DataFrame, capture: str, shape: Sequence[str]) -> DataFrame:
    return packets.join(dominant_shape(packets, capture, shape), on=[capture, *shape], how="left_semi")
