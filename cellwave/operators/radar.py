"""Radar cube, projections, subspace spectra and heatmaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.functions.columns import SPEED_OF_LIGHT
from cellwave.functions.kernels import array_kernel, periodic_window
from cellwave.model import KEY, Signal
from cellwave.operators.spectral import _exploded, map_block, map_linear


def range_fft(sig: Signal, axis: str = "adc", window: str = "hann", n_fft: int | None = None, method: str = "auto") -> Signal:
    """Windowed orthonormal FFT over fast time."""

    def kernel(x):
        return np.fft.fft(x * periodic_window(window, x.shape[1]), n=n_fft, axis=1, norm="ortho")

    return map_linear(sig, axis, kernel, "range", method)


def doppler_fft(sig: Signal, axis: str = "chirp", window: str = "hann", fft_shift: bool = True, method: str = "auto") -> Signal:
    """Windowed orthonormal FFT over slow time, zero velocity in the middle."""

    def kernel(x):
        out = np.fft.fft(x * periodic_window(window, x.shape[1]), axis=1, norm="ortho")
        return np.fft.fftshift(out, axes=1) if fft_shift else out

    return map_linear(sig, axis, kernel, "doppler", method)


def angle_fft(sig: Signal, axis: str = "ant", num_bins: int = 64, fft_shift: bool = True, method: str = "auto") -> Signal:
    """Zero-padded orthonormal FFT over antennas."""

    def kernel(x):
        out = np.fft.fft(x, n=num_bins, axis=1, norm="ortho")
        return np.fft.fftshift(out, axes=1) if fft_shift else out

    return map_linear(sig, axis, kernel, "angle", method)


def radar_cube(sig: Signal, num_angle_bins: int = 64, window: str = "hann") -> Signal:
    """Range, Doppler and angle FFT of every frame with one exchange."""
    sig.require("chirp", "adc", "ant")

    def kernel(x):
        _, chirps, samples, _ = x.shape
        x = x * periodic_window(window, samples)[None, None, :, None]
        x = np.fft.fft(x, axis=2, norm="ortho")
        x = x * periodic_window(window, chirps)[None, :, None, None]
        x = np.fft.fftshift(np.fft.fft(x, axis=1, norm="ortho"), axes=1)
        x = np.fft.fftshift(np.fft.fft(x, n=num_angle_bins, axis=3, norm="ortho"), axes=3)
        return x

    shape = {"doppler": F.col("_n_chirp"), "range": F.col("_n_adc"), "angle": num_angle_bins}
    return map_block(sig, ["chirp", "adc", "ant"], kernel, shape)


def range_coordinate(idx: Column, bandwidth: Column) -> Column:
    return idx * F.lit(SPEED_OF_LIGHT) / (2.0 * bandwidth)


def doppler_coordinate(idx: Column, n: int, center_freq: Column, chirp_period: Column) -> Column:
    wavelength = F.lit(SPEED_OF_LIGHT) / center_freq
    return (idx - n // 2 - n % 2) * wavelength / (2.0 * n * chirp_period)


def angle_coordinate(idx: Column, bins: int) -> Column:
    """Degrees on an even sine grid from -1 to 1."""
    u = F.lit(-1.0) if bins == 1 else idx * 2.0 / (bins - 1) - 1.0
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u))))


def _project(sig: Signal, axis: str, reduce: str, to_db: bool) -> Signal:
    sig.require(axis)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im") if sig.is_complex else F.col("value") * F.col("value")
    fold = {"sum": F.sum, "max": F.max, "mean": F.avg}[reduce]
    out = sig.cells.groupBy(*sig.keys(axis)).agg(fold(power).alias("value"))
    if to_db:
        out = out.withColumn("value", 10.0 * F.log10(F.greatest(F.col("value"), F.lit(1e-20))))
    return sig.with_cells(out, [a for a in sig.axes if a != axis])


def range_doppler(sig: Signal, reduce: str = "sum", to_db: bool = False) -> Signal:
    return _project(sig, "angle", reduce, to_db)


def range_angle(sig: Signal, reduce: str = "sum", to_db: bool = False) -> Signal:
    return _project(sig, "doppler", reduce, to_db)


def spatial_covariance(
    sig: Signal, sensor: str, snapshot: str, chunk: int = 4096
) -> DataFrame:
    """``(keys, i, j, re, im, snapshots)``: mean of x_i * conj(x_j) over snapshots.

    Snapshots are packed in bounded chunks whose partial matrices add up, so a
    long capture never meets in one task before it is reduced.
    """
    sig.require(sensor, snapshot, kind="complex")
    keys = [KEY, *(a for a in sig.axes if a not in (sensor, snapshot))]
    part = F.floor(F.col(snapshot) / F.lit(chunk)).alias("_chunk")
    packed = sig.cells.groupBy(*keys, part).agg(
        F.array_sort(F.collect_list(F.struct(snapshot, sensor, "re", "im"))).alias("_rows"),
        (F.max(sensor) + 1).cast("int").alias("_n"),
    )
    packed = packed.select(*keys, "_n", F.col("_rows.re").alias("re"), F.col("_rows.im").alias("im"))

    def kernel(x, n):
        snaps = x.reshape(x.shape[0], -1, n)
        return np.swapaxes(snaps, 1, 2) @ snaps.conj()

    done = packed.withColumn("_y", array_kernel(kernel, ["re", "im"], F.col("_n"))).withColumn(
        "_count", F.size("re") / F.col("_n")
    )
    cells = _exploded(done, [*keys, "_n", "_count"], "_i", False)
    n = F.col("_n")
    return (
        cells.groupBy(*keys, F.floor(F.col("_i") / n).alias("i"), F.pmod(F.col("_i"), n).cast("bigint").alias("j"))
        .agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("_count").alias("snapshots"))
        .withColumns({p: F.col(p) / F.col("snapshots") for p in ("re", "im")})
    )


def aoa_steering(angles_deg: np.ndarray, positions: Sequence[float], wavelength: float) -> np.ndarray:
    phase = 2.0 * np.pi / wavelength * np.sin(np.deg2rad(angles_deg))[:, None] * np.asarray(positions)[None, :]
    return np.exp(-1j * phase)


def tof_steering(delays_s: np.ndarray, offsets_hz: Sequence[float]) -> np.ndarray:
    return np.exp(-2j * np.pi * delays_s[:, None] * np.asarray(offsets_hz)[None, :])


def music_spectrum(
    sig: Signal,
    mode: str,
    sensor: str,
    snapshot: str,
    num_sources: int,
    num_bins: int = 181,
    scan: tuple[float, float] = (-90.0, 90.0),
    positions: Sequence[float] | None = None,
    center_freq: float | None = None,
    subcarrier_indices: Sequence[int] | None = None,
    subcarrier_spacing: float | None = None,
) -> Signal:
    """MUSIC pseudo-spectrum over angle (``aoa``) or delay (``tof``).

    The covariance is a Spark aggregate; only the small matrix reaches the
    eigen kernel.
    """
    grid = np.linspace(scan[0], scan[1], num_bins)
    if mode == "aoa":
        if positions is None or center_freq is None:
            raise ValueError("aoa needs antenna positions and center_freq")
        steering, axis = aoa_steering(grid, positions, SPEED_OF_LIGHT / center_freq), "aoa_bin"
    elif mode == "tof":
        if subcarrier_indices is None or subcarrier_spacing is None:
            raise ValueError("tof needs subcarrier indices and spacing")
        offsets = np.asarray(subcarrier_indices, dtype=float) * subcarrier_spacing
        steering, axis = tof_steering(grid, offsets), "tof_bin"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    sensors = steering.shape[1]
    if num_sources >= sensors:
        raise ValueError("num_sources must be smaller than the number of sensors")

    def kernel(x, snapshots):
        if snapshots < 2:
            raise ValueError("MUSIC needs at least 2 snapshots")
        if x.shape[1] != sensors * sensors:
            raise ValueError(f"geometry has {sensors} sensors, covariance {x.shape[1]} entries")
        cov = x.reshape(-1, sensors, sensors)
        noise = np.linalg.eigh(cov)[1][:, :, : sensors - num_sources]
        distance = np.sum(np.abs(steering.conj() @ noise) ** 2, axis=2)
        return 1.0 / np.maximum(distance, 1e-8)

    covariance = spatial_covariance(sig, sensor, snapshot)
    keys = [KEY, *(a for a in sig.axes if a not in (sensor, snapshot))]
    packed = covariance.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "re", "im"))).alias("_rows"), F.max("snapshots").alias("_s")
    ).select(*keys, "_s", F.col("_rows.re").alias("re"), F.col("_rows.im").alias("im"))
    done = packed.withColumn("_y", array_kernel(kernel, ["re", "im"], F.col("_s"), real=True))
    kept = [a for a in sig.axes if a not in (sensor, snapshot)]
    return sig.with_cells(_exploded(done, keys, axis, True), [*kept, axis])


def elevation_azimuth_heatmap(
    sig: Signal,
    azimuth_bins: int = 64,
    elevation_bins: int = 8,
    range_bins: Sequence[int] = range(94, 30, -1),
    group_chirps: int = 4,
) -> Signal:
    """Heatmap (proc_chirp, range, azimuth, elevation) of TDM frames (ant, chirp, adc).

    Chirps cycle over three transmitters: 0 and 2 form the azimuth row, 1 the
    elevated row shifted by two positions. Each row loses its static part, goes
    through range-Doppler FFTs, then elevation and azimuth FFTs; the middle
    1/group_chirps of the Doppler bins is kept with the listed range bins.
    """
    sig.require("ant", "chirp", "adc", kind="complex")
    picked = list(range_bins)

    def kernel(x):
        rows, receivers, chirps, samples = x.shape
        steps = chirps // 3
        looks = x[:, :, : steps * 3].reshape(rows, receivers, steps, 3, samples)
        looks = looks - looks.mean(axis=2, keepdims=True)
        spectra = np.fft.fft2(looks, axes=(2, 4))
        array = np.zeros((rows, elevation_bins, azimuth_bins, steps, samples), dtype=complex)
        array[:, 0, :receivers] = spectra[:, :, :, 0]
        array[:, 0, receivers : 2 * receivers] = spectra[:, :, :, 2]
        array[:, 1, 2 : 2 + receivers] = spectra[:, :, :, 1]
        # only positions 2..5 carry both rows
        array[:, :, 2:6] = np.fft.fft(array[:, :, 2:6], axis=1)
        array = np.fft.fft(array, axis=2)
        array = np.fft.fftshift(array[..., picked], axes=(1, 2, 3))[:, ::-1, ::-1]
        kept = steps // group_chirps
        out = np.zeros((rows, kept, len(picked), azimuth_bins, elevation_bins), dtype=complex)
        half = kept // 2
        out[:, : 2 * half] = array[:, :, :, steps // 2 - half : steps // 2 + half].transpose(0, 3, 4, 2, 1)
        return out

    shape = {
        "proc_chirp": F.floor(F.floor(F.col("_n_chirp") / 3) / group_chirps), "range": len(picked),
        "azimuth": azimuth_bins, "elevation": elevation_bins,
    }
    return map_block(sig, ["ant", "chirp", "adc"], kernel, shape)
