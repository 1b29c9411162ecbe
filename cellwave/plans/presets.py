"""Presets: common chains as functions that return one composed step."""

from __future__ import annotations

from collections.abc import Sequence

from cellwave.operators import adapters, normalize, radar, series
from cellwave.plans.compose import Step, compose, step


def radar_cube(window: str = "hann", num_bins: int = 64) -> Step:
    """Range, Doppler and angle FFT in a row."""
    return compose(
        step(radar.range_fft, axis="adc", window=window),
        step(radar.doppler_fft, axis="chirp", window=window),
        step(radar.angle_fft, axis="ant", num_bins=num_bins),
    )


def csi_sequence(
    sample_rate: float = 1000,
    # fixed values: cut-offs and orders of the published chain
    lowpass_hz: float = 60.0,
    highpass_hz: float = 2.0,
    lowpass_order: int = 6,
    highpass_order: int = 3,
    sample_zscore: bool = False,
    feature_axes: Sequence[str] = ("subc", "tx", "rx", "feature"),
) -> Step:
    """Cleaned CSI as (time, feature) amplitude and phase sequences."""
    clean = [
        step(normalize.subcarrier_l1),
        step(series.adjacent_rx_conjugate),
        step(
            series.temporal_filter, sample_rate=sample_rate, lowpass_hz=lowpass_hz, highpass_hz=highpass_hz,
            lowpass_order=lowpass_order, highpass_order=highpass_order,
        ),
        step(normalize.amplitude_phase),
    ]
    scaled = [step(normalize.sample_zscore, exclude_axes=["feature"])] if sample_zscore else []
    contract = adapters.InputContract(("time", "feature"))
    shaped = step(adapters.auto_align, contract=contract, axis_map={"feature": tuple(feature_axes)}, value="identity")
    return compose(*clean, *scaled, shaped)
