"""Element-wise operators and normalisers.

Statistics come from packed rows of cells, in one read: a sample that holds most
of the cells is many of them. ``packed.py``
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import SPEED_OF_LIGHT, clamp
from cellwave.model import KEY, Signal
from cellwave.operators.axes import with_lengths
from cellwave.operators.packed import with_statistics

# Smallest positive step of the 64-bit float type.
FLOAT_EPS = 2.220446049250313e-16


def magnitude(sig: Signal) -> Signal:
    sig.require(kind="complex")
    return sig.with_parts(value=F.hypot("re", "im"))


def amplitude_phase(sig: Signal, unwrap_axis: str | None = None) -> Signal:
    """New last axis ``feature``: 0 amplitude, 1 phase (unwrapped if asked)."""
    sig.require(kind="complex")
    amp = sig.with_parts(value=F.hypot("re", "im")).cells.withColumn("feature", F.lit(0).cast("bigint"))
    if unwrap_axis:
        from cellwave.operators.series import phase_unwrap

        phase = phase_unwrap(sig, unwrap_axis).cells.withColumn("feature", F.lit(1).cast("bigint"))
        return sig.with_cells(amp.unionByName(phase), [*sig.axes, "feature"], {"feature": 2})
    both = F.posexplode(F.array(F.hypot("re", "im"), F.atan2("im", "re"))).alias("feature", "value")
    return sig.with_cells(sig.cells.select(*sig.keys(), both), [*sig.axes, "feature"], {"feature": 2})


def _scaled(sig: Signal, df: DataFrame, factor: Column, **shift: Column) -> Signal:
    parts = {p: (F.col(p) - shift[p] if p in shift else F.col(p)) * factor for p in sig.parts}
    return sig.with_cells(df.select(*sig.keys(), *(e.alias(p) for p, e in parts.items())))


def minmax(sig: Signal, low: float = 0.0, high: float = 1.0, eps: float = 1e-8) -> Signal:
    sig.require(kind="real")
    df = with_statistics(sig, [KEY], F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    unit = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
    return sig.with_cells(df.withColumn("value", unit * (high - low) + low))


def _zscored(sig: Signal, keys: Sequence[str], eps: float) -> Signal:
    """Unbiased deviation; complex cells use the centred modulus."""
    if sig.is_complex:
        std = F.coalesce(F.sqrt(F.var_samp("re") + F.var_samp("im")), F.lit(0.0))
        means = [F.avg("re").alias("_m_re"), F.avg("im").alias("_m_im")]
    else:
        std, means = F.stddev_samp("value"), [F.avg("value").alias("_m_value")]
    df = with_statistics(sig, list(keys), std.alias("_std"), *means)
    floor = F.when(F.col("_std").isNotNull(), F.greatest(F.col("_std"), F.lit(eps)))
    return _scaled(sig, df, 1.0 / floor, **{p: F.col(f"_m_{p}") for p in sig.parts})


def _norm(sig: Signal) -> Column:
    return F.sqrt(F.sum(sum((F.col(p) * F.col(p) for p in sig.parts[1:]), F.col(sig.parts[0]) * F.col(sig.parts[0]))))


def _l2(sig: Signal, keys: Sequence[str], eps: float) -> Signal:
    df = with_statistics(sig, list(keys), _norm(sig).alias("_norm"))
    return _scaled(sig, df, 1.0 / F.greatest(F.col("_norm"), F.lit(eps)))


def zscore(sig: Signal, eps: float = 1e-8) -> Signal:
    return _zscored(sig, [KEY], eps)


def l2(sig: Signal, eps: float = 1e-8) -> Signal:
    return _l2(sig, [KEY], eps)


def normalize(sig: Signal, method: str = "minmax", range: tuple[float, float] = (0.0, 1.0)) -> Signal:
    if method == "minmax":
        return minmax(sig, *range)
    if method == "zscore":
        return zscore(sig)
    if method == "l2":
        return l2(sig)
    raise ValueError(f"unknown method {method!r}")


def axis_normalize(sig: Signal, axis: str, method: str = "l2", eps: float = 1e-8) -> Signal:
    """Normalise every series along one axis."""
    sig.require(axis)
    if method not in ("l2", "zscore"):
        raise ValueError(f"unknown method {method!r}")
    return (_l2 if method == "l2" else _zscored)(sig, sig.keys(axis), eps)


def sample_zscore(sig: Signal, exclude_axes: Sequence[str] = (), eps: float = 1e-8) -> Signal:
    """Z-score per sample and per excluded axis index."""
    if set(sig.axes) <= set(exclude_axes):
        raise ValueError("at least one axis must be normalised")
    return _zscored(sig, [KEY, *(a for a in sig.axes if a in exclude_axes)], eps)


def subcarrier_l1(
    sig: Signal, axis: str = "subc", eps: float = FLOAT_EPS, skip_reader_ids: Sequence[str] = ()
) -> Signal:
    """Divide by the summed modulus along an axis; listed readers pass unchanged."""
    sig.require(axis, kind="complex")
    df = with_statistics(sig, sig.keys(axis), F.sum(F.hypot("re", "im")).alias("_sum"))
    factor = 1.0 / F.greatest(F.col("_sum"), F.lit(eps))
    if skip_reader_ids:
        df = df.join(sig.samples.select(KEY, "reader_id"), on=KEY)
        skipped = F.coalesce(F.col("reader_id").isin(list(skip_reader_ids)), F.lit(False))
        factor = F.when(skipped, F.lit(1.0)).otherwise(factor)
    return _scaled(sig, df, factor)


def spatial_channels(sig: Signal, channel: str = "channel", eps: float = 1e-8) -> Signal:
    """Per channel: shift to zero, scale to one, then z-score.

    The statistics of the scaled values follow from those of the raw ones, so
    one aggregation is enough.
    """
    sig.require(channel, kind="real")
    df = with_statistics(sig, [KEY, channel],
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"),
    )
    peak = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(eps))
    scaled_std = F.greatest(F.col("_std") / peak, F.lit(eps))
    return sig.with_cells(df.withColumn("value", (F.col("value") - F.col("_mean")) / peak / scaled_std))


def rssi_normalize(sig: Signal, low: float = -100.0, high: float = 0.0) -> Signal:
    sig.require(kind="real")
    if high <= low:
        raise ValueError("rssi_max must exceed rssi_min")
    return sig.with_parts(value=clamp((F.col("value") - low) / (high - low), 0.0, 1.0))


def cir_normalize(sig: Signal, axis: str = "tap", eps: float = 1e-12) -> Signal:
    """Divide by the peak modulus along the tap axis."""
    sig.require(axis)
    df = with_statistics(sig, sig.keys(axis), F.max(sig.magnitude).alias("_peak"))
    return _scaled(sig, df, 1.0 / F.greatest(F.col("_peak"), F.lit(eps)))


def split_complex(sig: Signal, axis: str = "ri") -> Signal:
    """Real and imaginary part along a new leading axis."""
    sig.require(kind="complex")
    both = F.posexplode(F.array("re", "im")).alias(axis, "value")
    return sig.with_cells(sig.cells.select(*sig.keys(), both), [axis, *sig.axes], {axis: 2})


def polar_projection(
    sig: Signal, totals: dict[str, int], selected: dict[str, Sequence[int]] | None = None,
    apply_phase: bool = True,
) -> Signal:
    """Amplitudes on (time_bin, freq_bin, subc, link) become complex numbers whose
    phase is the cell's row-major place in the full lattice, scaled to pi.

    ``totals`` gives the lattice sizes (link, subcarrier, freq, time);
    ``selected`` maps a reduced axis back to lattice indexes.
    """
    sig.require("time_bin", "freq_bin", "subc", "link", kind="real")
    selected = selected or {}

    def place(column: str, name: str) -> Column:
        if name not in selected:
            return F.col(column)
        return F.element_at(F.array(*map(F.lit, selected[name])), F.col(column).cast("int") + 1)

    flat = place("link", "link")
    for column, name in (("subc", "subcarrier"), ("freq_bin", "freq"), ("time_bin", "time")):
        flat = flat * F.lit(totals[name]) + place(column, name)
    scale = math.pi / float(math.prod(totals[n] for n in ("link", "subcarrier", "freq", "time")) - 1)
    phase = flat * scale if apply_phase else F.lit(0.0)
    return sig.with_parts(re=F.col("value") * F.cos(phase), im=F.col("value") * F.sin(phase))


# Subcarrier unit names and their canonical form.
SUBCARRIER_UNITS = {
    "": "index", "index": "index", "hz": "offset_hz", "mhz": "offset_mhz",
    "offset_hz": "offset_hz", "offset_mhz": "offset_mhz", "freq_hz": "freq_hz", "freq_mhz": "freq_mhz",
}
# WiFi channel centre frequencies in MHz.
CHANNEL_MHZ = {
    1: 2412, 2: 2417, 3: 2422, 4: 2427, 5: 2432, 6: 2437, 7: 2442, 8: 2447, 9: 2452, 10: 2457,
    11: 2462, 12: 2467, 13: 2472, 14: 2484,
    36: 5180, 40: 5200, 44: 5220, 48: 5240, 52: 5260, 56: 5280, 60: 5300, 64: 5320,
    100: 5500, 104: 5520, 108: 5540, 112: 5560, 116: 5580, 120: 5600, 124: 5620, 128: 5640,
    132: 5660, 136: 5680, 140: 5700, 144: 5720, 149: 5745, 153: 5765, 157: 5785, 161: 5805, 165: 5825,
}


def convert_subcarriers(
    value: Column, from_unit: str | None, to_unit: str | None, spacing: Column, center: Column
) -> Column:
    """Subcarrier coordinate between index, offset and absolute frequency units.

    A missing or non-positive spacing gives null where the unit needs it.
    """
    source, target = (SUBCARRIER_UNITS.get((u or "").strip().lower()) for u in (from_unit, to_unit))
    if source is None or target is None:
        raise ValueError(f"unsupported subcarrier unit {from_unit!r} or {to_unit!r}")
    step = F.when(spacing > 0, spacing)
    scale = 1e6 if source.endswith("mhz") else 1.0
    if source == "index":
        index = value
    elif source.startswith("offset"):
        index = value * scale / step
    else:
        index = (value * scale - center) / step
    if target == "index":
        return index
    offset = index * step
    base = offset if target.startswith("offset") else center + offset
    return base / 1e6 if target.endswith("mhz") else base


def centered_subcarrier(idx: Column, count: Column) -> Column:
    """Subcarrier number around DC; an even count skips zero."""
    low = idx - F.floor(count / F.lit(2))
    return F.when((count % 2 == 0) & (low >= 0), low + 1).otherwise(low)


def channel_frequency(channel: Column) -> Column:
    """Centre frequency in Hz, null for an unknown channel."""
    pairs = [F.lit(x) for c, mhz in CHANNEL_MHZ.items() for x in (c, mhz * 1e6)]
    return F.try_element_at(F.create_map(*pairs), channel.cast("int"))


def bandwidth_from_count(count: Column, thresholds: dict[int, float]) -> Column:
    """Bandwidth of the first threshold that covers the count, else the widest."""
    result = F.lit(float(thresholds[max(thresholds)]))
    for limit in sorted(thresholds, reverse=True):
        result = F.when(count <= limit, F.lit(float(thresholds[limit]))).otherwise(result)
    return result


def radar_scalars(df: DataFrame) -> DataFrame:
    """Derived radar quantities from columns center_freq, bandwidth, chirp_period,
    num_adc_samples, num_chirps, num_tx, num_rx, num_frames."""
    wavelength = F.lit(SPEED_OF_LIGHT) / F.col("center_freq")
    range_res = F.lit(SPEED_OF_LIGHT) / (2.0 * F.col("bandwidth"))
    doppler = wavelength / (2.0 * F.col("num_chirps") * F.col("chirp_period"))
    size = F.lit(4).cast("bigint")
    for c in ("num_frames", "num_chirps", "num_tx", "num_rx", "num_adc_samples"):
        size = size * F.col(c)
    return df.withColumns({
        "wavelength": wavelength,
        "range_resolution": range_res,
        "max_range": range_res * F.col("num_adc_samples") / 2.0,
        "doppler_resolution": doppler,
        "max_velocity": doppler * F.col("num_chirps") / 2.0,
        "file_bytes": size,
    })
