"""Axis algebra on cell tables: index arithmetic instead of data movement."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwave.functions.columns import null_safe
from cellwave.model import KEY, Signal


def axis_lengths(sig: Signal, *axes: str) -> DataFrame:
    """One row per sample with ``_len_<axis>``."""
    return sig.cells.groupBy(KEY).agg(
        *((F.max(a) + 1).cast("bigint").alias(f"_len_{a}") for a in axes)
    )


def with_lengths(sig: Signal, *axes: str, sizes: dict[str, int] | None = None) -> DataFrame:
    """Cells with axis lengths, taken from ``sizes`` where the caller knows them."""
    sizes = {**sig.sizes, **(sizes or {})}
    unknown = [a for a in axes if a not in sizes]
    cells = null_safe(sig.cells, axis_lengths(sig, *unknown), [KEY]) if unknown else sig.cells
    return cells.withColumns({f"_len_{a}": F.lit(sizes[a]).cast("bigint") for a in axes if a in sizes})


def _on_axis(coords: DataFrame | None, axis: str, keep: Column, idx: Column) -> DataFrame | None:
    """Apply the same selection to the axis' coordinates."""
    if coords is None:
        return None
    here = F.col("axis") == axis
    return coords.where(~here | keep).withColumn("idx", F.when(here, idx).otherwise(F.col("idx")))


def select_index(sig: Signal, **picks: int | slice) -> Signal:
    """An int drops the axis, a slice keeps it and re-bases its index.

    Negative bounds count from each sample's own end. A time slice shifts
    ``timestamp_start`` by start / sample_rate.
    """
    for axis, pick in picks.items():
        sig.require(axis)
        sig = _select_one(sig, axis, pick)
    return sig


def _from_start(pick: int | slice, size: int) -> int | slice:
    """Negative bounds of a known axis length as plain ones."""
    if isinstance(pick, int):
        return pick + size if pick < 0 else pick
    at = [e if e is None or e >= 0 else max(e + size, 0) for e in (pick.start, pick.stop)]
    return slice(at[0], at[1], pick.step)


def _select_one(sig: Signal, axis: str, pick: int | slice) -> Signal:
    if axis in sig.sizes:
        pick = _from_start(pick, sig.sizes[axis])
    ends = [pick] if isinstance(pick, int) else [pick.start, pick.stop]
    cells, coords = sig.cells, sig.coords
    if any(e is not None and e < 0 for e in ends):
        lengths = axis_lengths(sig, axis)
        cells = cells.join(lengths, on=KEY)
        coords = coords.join(lengths, on=KEY) if coords is not None else None
    size = F.col(f"_len_{axis}")

    def bound(e: int) -> Column:
        return F.lit(e) if e >= 0 else F.greatest(size + e, F.lit(0))

    if isinstance(pick, int):
        at = F.lit(pick) if pick >= 0 else size + pick
        kept = [a for a in sig.axes if a != axis]
        coords = coords.where(F.col("axis") != axis).select(sig.coords.columns) if coords is not None else None
        return replace(sig.with_cells(cells.where(F.col(axis) == at), kept), coords=coords)
    step = pick.step or 1
    if step < 1:
        raise ValueError("slice step must be positive")
    start = bound(pick.start or 0)

    def inside(i: Column) -> Column:
        ok = i >= start
        if pick.stop is not None:
            ok = ok & (i < bound(pick.stop))
        return ok & (F.pmod(i - start, F.lit(step)) == 0) if step > 1 else ok

    rebased = F.floor((F.col(axis) - start) / F.lit(step))
    out = cells.where(inside(F.col(axis))).withColumn(axis, rebased)
    if coords is not None:
        moved = F.floor((F.col("idx") - start) / F.lit(step))
        coords = _on_axis(coords, axis, inside(F.col("idx")), moved).select(sig.coords.columns)
    samples = sig.samples
    if axis == "time" and samples is not None and (pick.start or 0) > 0 and "timestamp_start" in samples.columns:
        shift = F.lit(float(pick.start)) / F.col("sample_rate")
        samples = samples.withColumn("timestamp_start", F.col("timestamp_start") + shift)
    known = sig.sizes.get(axis)
    size = None if known is None else len(range(known)[pick])
    return replace(sig.with_cells(out, sizes={axis: size}), coords=coords, samples=samples)


def index_bounds_problems(sig: Signal, axis: str, index: int) -> DataFrame:
    """Samples whose axis is too short for the index."""
    need = index + 1 if index >= 0 else -index
    return axis_lengths(sig, axis).where(F.col(f"_len_{axis}") < need)


def coordinate_values(sig: Signal, axis: str) -> DataFrame:
    """Coordinate lookup by axis name."""
    if sig.coords is None:
        raise ValueError("the signal carries no coordinates")
    return sig.coords.where(F.col("axis") == axis).select(KEY, "idx", "value", "unit")


def concat(parts: Sequence[Signal], axis: str) -> Signal:
    """Append signals along an axis; each part is shifted by the lengths before it."""
    axes = parts[0].axes
    for p in parts:
        p.require(axis)
        if set(p.axes) != set(axes):
            raise ValueError(f"concat needs equal axes: {axes} vs {p.axes}")
    tagged = [p.cells.select(*parts[0].cells.columns).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    cells = fold(DataFrame.unionByName, tagged)
    lengths = cells.groupBy(KEY, "_part").agg((F.max(axis) + 1).alias("_n"))
    before = Window.partitionBy(KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(KEY, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    def shifted(df: DataFrame, col: str, when: Column) -> DataFrame:
        return df.join(starts, on=[KEY, "_part"]).withColumn(
            col, F.when(when, F.col(col) + F.col("_start")).otherwise(F.col(col))
        ).drop("_part", "_start")

    coords = None
    if all(p.coords is not None for p in parts):
        both = [
            # other axes keep the first part's coordinates
            (p.coords if i == 0 else p.coords.where(F.col("axis") == axis)).withColumn("_part", F.lit(i))
            for i, p in enumerate(parts)
        ]
        coords = shifted(fold(DataFrame.unionByName, both), "idx", F.col("axis") == axis)
    out = shifted(cells, axis, F.lit(True))
    known = [p.sizes.get(axis) for p in parts]
    size = None if None in known else sum(known)
    return replace(parts[0].with_cells(out, sizes={axis: size}), coords=coords)


def concat_problems(samples: Sequence[DataFrame], tolerance: float = 1e6) -> DataFrame:
    """Parts whose centre frequency or bandwidth differs from the first part's."""
    fields = ("center_freq", "bandwidth")
    tagged = [s.select(KEY, *fields).withColumn("part", F.lit(i)) for i, s in enumerate(samples)]
    rows = fold(DataFrame.unionByName, tagged[1:])
    first = samples[0].select(KEY, *(F.col(f).alias(f"_{f}") for f in fields))
    checks = F.array_compact(
        F.array(*(F.when(F.abs(F.col(f) - F.col(f"_{f}")) > tolerance, F.lit(f)) for f in fields))
    )
    return rows.join(first, on=KEY).select(KEY, "part", F.explode(checks).alias("field"))


def permute(sig: Signal, *axes: str) -> Signal:
    if set(axes) != set(sig.axes) or len(axes) != len(sig.axes):
        raise ValueError(f"permute needs the axes {sig.axes}, got {axes}")
    return sig.with_cells(sig.cells, axes)


def merge_axes(sig: Signal, axes: Sequence[str], name: str, sizes: dict[str, int] | None = None) -> Signal:
    """Flatten axes row-major into one; the last varies fastest."""
    sig.require(*axes)
    cells = with_lengths(sig, *axes[1:], sizes=sizes)
    flat = F.col(axes[0]).cast("bigint")
    for a in axes[1:]:
        flat = flat * F.col(f"_len_{a}") + F.col(a)
    kept = [a for a in sig.axes if a not in axes]
    at = min(sig.axes.index(a) for a in axes)
    order = [*kept[:at], name, *kept[at:]] if at <= len(kept) else [*kept, name]
    known = [{**sig.sizes, **(sizes or {})}.get(a) for a in axes]
    size = None if None in known else math.prod(known)
    return sig.with_cells(
        cells.withColumn("_flat", flat).drop(*axes).withColumnRenamed("_flat", name), order, {name: size}
    )


def split_axis(sig: Signal, axis: str, sizes: dict[str, int]) -> Signal:
    """Undo a row-major flatten; the first size may be any (it is not needed)."""
    sig.require(axis)
    names, rest = list(sizes), F.col(axis)
    parts: dict[str, Column] = {}
    for name in reversed(names[1:]):
        parts[name] = F.pmod(rest, F.lit(sizes[name]))
        rest = F.floor(rest / F.lit(sizes[name]))
    parts[names[0]] = rest
    at = sig.axes.index(axis)
    order = [*sig.axes[:at], *names, *sig.axes[at + 1 :]]
    others = [a for a in sig.axes if a != axis]
    cells = sig.cells.select(KEY, *others, *(parts[n].alias(n) for n in names), *sig.parts)
    return sig.with_cells(cells, order, {n: sizes[n] or None for n in names})


def _groups(side: str) -> list[tuple[str, ...]]:
    tokens = re.findall(r"\(([^)]*)\)|(\S+)", side.strip())
    return [tuple(g.split()) if not one else (one,) for g, one in tokens]


def _group_name(group: tuple[str, ...]) -> str:
    return group[0] if len(group) == 1 else "_".join(group)


def rearrange(sig: Signal, pattern: str, **sizes: int) -> Signal:
    """Axis pattern ``"a (b c) -> c (a b)"``; a merged axis is named ``a_b``."""
    left, right = (_groups(s) for s in pattern.split("->"))
    names = [n for g in left for n in g]
    if sorted(names) != sorted(n for g in right for n in g):
        raise ValueError(f"both sides of {pattern!r} must name the same axes")
    if len(left) != len(sig.axes):
        raise ValueError(f"pattern {pattern!r} does not fit axes {sig.axes}")
    for axis, group in zip(sig.axes, left):
        if len(group) > 1:
            sig = split_axis(sig, axis, {n: sizes.get(n, 0) for n in group})
        elif group[0] != axis:
            raise ValueError(f"pattern axis {group[0]!r} is not {axis!r}")
    for group in right:
        if len(group) > 1:
            sig = merge_axes(sig, group, _group_name(group), sizes)
    return permute(sig, *map(_group_name, right))


REDUCTIONS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "prod": F.product}


def reduce_axes(sig: Signal, keep: Sequence[str], reduction: str = "mean") -> Signal:
    """Aggregate every axis not kept; complex cells reduce on their magnitude."""
    sig.require(*keep)
    value = F.hypot("re", "im") if sig.is_complex else F.col("value")
    out = sig.cells.groupBy(KEY, *keep).agg(REDUCTIONS[reduction](value).alias("value"))
    return sig.with_cells(out, keep)


def repeat(sig: Signal, axis: str, n: int) -> Signal:
    """Copy every cell along a new last axis."""
    if axis in sig.axes:
        raise ValueError(f"axis {axis!r} exists")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis)
    return sig.with_cells(sig.cells.select("*", copies), [*sig.axes, axis], {axis: n})


def resize_axis(sig: Signal, axis: str, length: int, crop: str = "left") -> Signal:
    """Crop left or center, or zero-pad at the end; an absent axis changes nothing.

    Time coordinates of the padding continue at one sample period.
    """
    if axis not in sig.axes:
        return sig
    if length <= 0:
        raise ValueError("target length must be positive")
    size = F.col(f"_len_{axis}")
    start = F.lit(0).cast("bigint")
    if crop == "center":
        start = F.greatest(F.lit(0), F.floor((size - length) / F.lit(2)))
    cells, i = with_lengths(sig, axis), F.col(axis).cast("bigint")
    none = F.array().cast("array<bigint>")
    inside = F.when((i >= start) & (i < start + length), F.array(i - start)).otherwise(none)
    # the first cell of a short series also emits the padding
    padding = F.when(
        (i == 0) & (size < length), F.sequence(size, F.lit(length - 1).cast("bigint"))
    ).otherwise(none)
    rows = cells.withColumn("_to", F.explode(F.concat(inside, padding)))
    is_pad = F.col("_to") >= size
    rows = rows.withColumns({p: F.when(is_pad, F.lit(0.0)).otherwise(F.col(p)) for p in sig.parts})
    out = sig.with_cells(rows.drop(axis).withColumnRenamed("_to", axis), sizes={axis: length})
    out = replace(out, coords=None)
    if sig.coords is None:
        return out
    lengths = axis_lengths(sig, axis)
    here = sig.coords.where(F.col("axis") == axis).join(lengths, on=KEY)
    cut = here.where((F.col("idx") >= start) & (F.col("idx") < start + length)).withColumn(
        "idx", F.col("idx") - start
    )
    extra = here.where((F.col("idx") == size - 1) & (size < length))
    if sig.samples is not None and "sample_rate" in sig.samples.columns:
        extra = extra.join(sig.samples.select(KEY, "sample_rate"), on=KEY)
        steps = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(length) - size))
        extra = extra.withColumn("_k", steps).withColumns(
            {"idx": F.col("idx") + F.col("_k"), "value": F.col("value") + F.col("_k") / F.col("sample_rate")}
        )
    else:
        extra = extra.where(F.lit(False))
    names = sig.coords.columns
    others = sig.coords.where(F.col("axis") != axis)
    coords = others.unionByName(cut.select(names)).unionByName(extra.select(names))
    return replace(out, coords=coords)


def temporal_resize(
    sig: Signal,
    axis: str,
    length: int,
    mode: str = "linear",
    align_corners: bool = False,
    sizes: dict[str, int] | None = None,
) -> Signal:
    """Resample an axis to a fixed length.

    Linear: every source cell spreads over the targets within one step of it
    with hat weights, so one partial aggregation replaces two index joins.
    """
    sig.require(axis)
    if length <= 0:
        raise ValueError("target length must be positive")
    cells = with_lengths(sig, axis, sizes=sizes)
    size, i, target = F.col(f"_len_{axis}"), F.col(axis), F.lit(length)
    ratio = size / target

    def span(low: Column, high: Column) -> Column:
        low = F.greatest(F.lit(0), F.floor(low))
        high = F.least(target - 1, F.ceil(high)).cast("bigint")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    j = F.col("_j")
    if mode == "nearest":
        rows = cells.withColumn("_j", F.explode(span(i / ratio - 1, (i + 1) / ratio + 1)))
        rows = rows.where(F.least(F.floor(j * ratio), size - 1) == i)
        return sig.with_cells(rows.drop(axis).withColumnRenamed("_j", axis), sizes={axis: length})
    if mode != "linear":
        raise ValueError(f"unknown mode {mode!r}")
    if align_corners:
        step = F.when(target > 1, (size - 1) / (target - 1)).otherwise(F.lit(0.0))
        source = j * step
        reach = span(
            F.when(step > 0, (i - 1) / step - 1).otherwise(F.lit(0.0)),
            F.when(step > 0, (i + 1) / step + 1).otherwise(target - 1.0),
        )
    else:
        source = (j + 0.5) * ratio - 0.5
        # the first and last cell also serve every clamped target
        low = F.when(i == 0, F.lit(0.0)).otherwise((i - 0.5) / ratio - 1.5)
        high = F.when(i == size - 1, target - 1.0).otherwise((i + 1.5) / ratio + 0.5)
        reach = span(low, high)
    at = F.greatest(F.lit(0.0), F.least(source, (size - 1).cast("double")))
    weight = F.lit(1.0) - F.abs(at - i)
    rows = cells.withColumn("_j", F.explode(reach)).withColumn("_w", weight).where("_w > 0")
    out = rows.groupBy(*sig.keys(axis), j.alias(axis)).agg(
        *(F.sum(F.col(p) * F.col("_w")).alias(p) for p in sig.parts)
    )
    return replace(sig.with_cells(out, sizes={axis: length}), coords=None)


def resized_coordinates(sig: Signal, axis: str, length: int) -> DataFrame:
    """Evenly spaced coordinates from the first to the last old value."""
    ends = sig.coords.where(F.col("axis") == axis).groupBy(KEY, "unit").agg(
        F.min_by("value", "idx").alias("_a"), F.max_by("value", "idx").alias("_b")
    )
    step = (F.col("_b") - F.col("_a")) / F.lit(max(length - 1, 1))
    return ends.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select(
        KEY, F.lit(axis).alias("axis"), F.col("idx").cast("bigint").alias("idx"),
        (F.col("_a") + F.col("idx") * step).alias("value"), "unit",
    )


def pack_series(sig: Signal, axis: str) -> DataFrame:
    """One row per series: ``(keys, re[], im[])`` or ``(keys, value[])`` in index order.

    Only for axes of bounded length.
    """
    sig.require(axis)
    rows = F.array_sort(F.collect_list(F.struct(axis, *sig.parts)))
    return (
        sig.cells.groupBy(*sig.keys(axis))
        .agg(rows.alias("_rows"))
        .select(*sig.keys(axis), *(F.col(f"_rows.{p}").alias(p) for p in sig.parts))
    )


def unpack_series(packed: DataFrame, keys: Sequence[str], axis: str, parts: Sequence[str]) -> DataFrame:
    """Series arrays back to cells."""
    zipped = F.arrays_zip(*parts) if len(parts) > 1 else F.transform(parts[0], lambda v: F.struct(v.alias(parts[0])))
    return packed.select(*keys, F.posexplode(zipped).alias(axis, "_c")).select(
        *keys, F.col(axis).cast("bigint").alias(axis), *(F.col(f"_c.{p}").alias(p) for p in parts)
    )


def unbatch(sig: Signal, axis: str = "batch") -> Signal:
    """A leading batch axis becomes part of the sample key."""
    sig.require(axis)
    key = F.concat_ws("/", F.col(KEY).cast("string"), F.col(axis).cast("string"))
    kept = [a for a in sig.axes if a != axis]
    sizes = {a: n for a, n in sig.sizes.items() if a in kept}
    return Signal(sig.cells.select(key.alias(KEY), *kept, *sig.parts), tuple(kept), sizes=sizes)


def stack(parts: Sequence[Signal], axis: str = "view") -> Signal:
    """Several signals of the same samples along a new leading axis."""
    for p in parts:
        if set(p.axes) != set(parts[0].axes) or p.parts != parts[0].parts:
            raise ValueError("stack needs equal axes and value kind")
    tagged = [p.cells.select(KEY, F.lit(i).cast("bigint").alias(axis), *p.axes, *p.parts) for i, p in enumerate(parts)]
    sizes = {a: n for a, n in parts[0].sizes.items() if all(p.sizes.get(a) == n for p in parts)}
    return Signal(
        fold(DataFrame.unionByName, tagged), (axis, *parts[0].axes), parts[0].samples, sizes={**sizes, axis: len(parts)}
    )
