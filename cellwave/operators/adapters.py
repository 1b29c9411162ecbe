"""Model-input shapes and point sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwave.model import KEY, Signal
from cellwave.operators.axes import axis_lengths, merge_axes
from cellwave.operators.packed import with_statistics


@dataclass(frozen=True)
class InputContract:
    """Axes, value kind and fixed sizes a model expects."""

    axes: tuple[str, ...]
    dtype_kind: str = "real"
    fixed_sizes: Mapping[str, int] = field(default_factory=dict)

    @property
    def family(self) -> str:
        if tuple(self.axes) == ("channel", "height", "width"):
            return "image"
        if tuple(self.axes) == ("time", "feature"):
            return "sequence"
        return "vector" if len(self.axes) == 1 else "generic"


def project_value(sig: Signal, value: str) -> Signal:
    """identity, magnitude, real or imag."""
    if value == "identity":
        return sig
    if not sig.is_complex:
        if value == "imag":
            raise ValueError("imag needs complex cells")
        # a real tensor passes through unchanged
        return sig
    exprs = {"magnitude": F.hypot("re", "im"), "real": F.col("re"), "imag": F.col("im")}
    if value not in exprs:
        raise ValueError(f"unsupported value projection {value!r}")
    return sig.with_parts(value=exprs[value])


def to_sequence(
    sig: Signal, flatten_axes: Sequence[str], time_axis: str = "time", value: str = "magnitude",
    sizes: dict[str, int] | None = None,
) -> Signal:
    """Flatten axes row-major to ``feature``; axes end in (time, feature)."""
    sig.require(time_axis, *flatten_axes)
    projected = sig
    if value == "magnitude":
        projected = sig.with_parts(value=sig.magnitude)
    elif value in ("real", "imag"):
        projected = project_value(sig, value)
    else:
        raise ValueError(f"unsupported value projection {value!r}")
    flat = merge_axes(projected, flatten_axes, "feature", sizes)
    rest = [a for a in flat.axes if a not in (time_axis, "feature")]
    return replace(flat.with_cells(flat.cells, [*rest, time_axis, "feature"]), coords=None)


def feature_arrays(sig: Signal, time_axis: str = "time", feature: str = "feature") -> DataFrame:
    """One feature array per (sample, time), for models that read arrays."""
    sig.require(time_axis, feature, kind="real")
    rows = F.array_sort(F.collect_list(F.struct(feature, "value")))
    return sig.cells.groupBy(*sig.keys(feature)).agg(rows.alias("_f")).select(
        *sig.keys(feature), F.col("_f.value").alias("features")
    )


def to_image(
    sig: Signal, height: str = "freq", width: str = "frame", channel_axes: Sequence[str] | None = None,
    stack_other: bool = False,
    sizes: dict[str, int] | None = None,
) -> Signal:
    """Merge channel axes row-major; axes end in (channel, height, width)."""
    sig.require(height, width)
    if channel_axes is None:
        others = [a for a in sig.axes if a not in (height, width, "batch")]
        channel_axes = others if stack_other else []
    if not channel_axes:
        raise ValueError("no channel axes; pass channel_axes")
    merged = merge_axes(sig, channel_axes, "channel", sizes)
    rest = [a for a in merged.axes if a not in ("channel", height, width)]
    return merged.with_cells(merged.cells, [*rest, "channel", height, width])


#: How a family fills its axes: "own" takes the axis of that name, "rest" all axes that nothing else takes,
#: "given" only what the caller names.
FILL = {
    "image": {"channel": "rest", "height": "own", "width": "own"},
    "sequence": {"time": "own", "feature": "rest"},
}


def _members(sig: Signal, contract: InputContract, given: Mapping[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Source axes of each contract axis, row-major."""
    free = [a for a in sig.axes if a != "batch"]
    if contract.family == "generic" and not given and tuple(free) == tuple(contract.axes):
        given = {a: (a,) for a in free}
    fill = FILL.get(contract.family) or dict.fromkeys(contract.axes, "rest" if contract.family == "vector" else "given")
    out = {a: given.get(a) or ((a,) if fill[a] == "own" else ()) for a in contract.axes}
    taken = {m for members in out.values() for m in members}
    rest = tuple(a for a in free if a not in taken)
    out |= {a: rest for a in contract.axes if fill[a] == "rest" and not out[a]}
    bad = {
        a: members for a, members in out.items()
        if not members or set(members) - set(free) or (fill[a] == "own" and len(members) > 1)
    }
    if bad:
        raise ValueError(f"no axes of {tuple(free)} make up {sorted(bad)} of {tuple(contract.axes)}; got {bad}")
    return out


def auto_align(
    sig: Signal,
    contract: InputContract,
    axis_map: Mapping[str, str | tuple[str, ...]] | None = None,
    height_axis: str | None = None,
    width_axis: str | None = None,
    time_axis: str | None = None,
    channel_axes: Sequence[str] | None = None,
    flatten_axes: Sequence[str] | None = None,
    value: str = "auto",
    sizes: dict[str, int] | None = None,
) -> Signal:
    """Group and rename axes to a model contract; resolved while the plan is built.

    ``axis_map`` names the source axes of a contract axis and goes before the single arguments.
    """
    single = {
        "height": height_axis, "width": width_axis, "time": time_axis, "channel": channel_axes, "feature": flatten_axes
    }
    named = {a: v for a, v in {**single, **(axis_map or {})}.items() if v and a in contract.axes}
    given = {a: (v,) if isinstance(v, str) else tuple(v) for a, v in named.items()}
    groups = list(_members(sig, contract, given).values())
    used = [a for g in groups for a in g]
    left = [a for a in sig.axes if a not in used and a != "batch"]
    if left:
        raise ValueError(f"axes {left} are not covered by the contract {contract.axes}")
    if value == "auto":
        value = "identity" if contract.dtype_kind == "complex" else "magnitude"
    out = project_value(sig, value)
    lead = [a for a in sig.axes if a == "batch"]
    names = [f"_to_{a}" for a in contract.axes]
    for target, members in zip(names, groups):
        if len(members) == 1:
            names_now = [target if a == members[0] else a for a in out.axes]
            known = {target: out.sizes.get(members[0])}
            out = out.with_cells(out.cells.withColumnRenamed(members[0], target), names_now, known)
        else:
            out = merge_axes(out, members, target, sizes)
    cells = out.cells.withColumnsRenamed(dict(zip(names, contract.axes)))
    known = {a: out.sizes.get(n) for n, a in zip(names, contract.axes)}
    return replace(out.with_cells(cells, [*lead, *contract.axes], known), coords=None)


def contract_problems(sig: Signal, contract: InputContract) -> DataFrame:
    """Per sample: axes whose size differs from the fixed one; kinds and names raise at once."""
    axes = tuple(a for a in sig.axes if a != "batch")
    if axes != tuple(contract.axes):
        raise ValueError(f"axes {axes} do not match the contract {contract.axes}")
    if sig.is_complex != (contract.dtype_kind == "complex"):
        raise ValueError(f"contract wants {contract.dtype_kind} cells")
    fixed = dict(contract.fixed_sizes)
    if not fixed:
        return sig.cells.select(KEY).limit(0).selectExpr(KEY, "'' AS axis", "0L AS expected", "0L AS actual")
    entries = F.array(*(
        F.struct(F.lit(a).alias("axis"), F.lit(n).cast("bigint").alias("expected"), F.col(f"_len_{a}").alias("actual"))
        for a, n in fixed.items()
    ))
    sizes = axis_lengths(sig, *fixed).select(KEY, F.explode(entries).alias("e"))
    return sizes.select(KEY, "e.*").where("expected <> actual")


def point_statistics(
    points: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    stats: Sequence[str] = ("mean", "max", "std"),
    frames: DataFrame | None = None,
) -> DataFrame:
    """Mean, max and population deviation per frame; an empty frame gives zeros.

    ``points`` has one row per valid point, ``frames`` the full list of keys.
    """
    unknown = [s for s in stats if s not in ("mean", "max", "std")]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}")
    fns = {"mean": F.avg, "max": F.max, "std": F.stddev_pop}
    names = [f"{s}_{f}" for s in stats for f in features]
    aggs = [fns[s](f).alias(f"{s}_{f}") for s in stats for f in features]
    pooled = points.groupBy(*keys).agg(*aggs)
    if frames is not None:
        pooled = frames.select(*keys).join(pooled, on=list(keys), how="left")
    return pooled.select(*keys, *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names))


def to_pointset(sig: Signal, threshold: float) -> DataFrame:
    """Cells above a share of the sample's peak modulus as ``(axes..., value)`` points."""
    rows = with_statistics(sig.with_parts(value=sig.magnitude), [KEY], F.max("value").alias("_peak"))
    return rows.where(F.col("value") > threshold * F.col("_peak")).drop("_peak")


def batch_pointsets(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of point sets with a ``batch`` number."""
    tagged = [p.withColumn("batch", F.lit(i)) for i, p in enumerate(parts)]
    return fold(DataFrame.unionByName, tagged)


def batch_layout(points: DataFrame, batch: str = "batch") -> DataFrame:
    """Length and offset of every member of a batched point set."""
    counts = points.groupBy(batch).agg(F.count("*").alias("length"))
    # one row per member; members are listed by the caller, so this is small
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def unbatch_pointset(points: DataFrame, member: int, batch: str = "batch") -> DataFrame:
    return points.where(F.col(batch) == member).drop(batch)
