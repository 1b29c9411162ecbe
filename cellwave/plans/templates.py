"""Preset templates: declared step lists, resolved while the plan is built.

A template has defaults, and variants that differ in the contract they end in. A step names an operator and its
parameters; a string ``$a.b`` stands for the value at that path of the defaults, over which the caller's parameters go.
``enabled_if`` switches a step. The variant is named, or found by the contract that the caller wants.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from pyspark.sql import functions as F

from cellwave.functions.columns import null_safe
from cellwave.model import KEY, Signal
from cellwave.operators import adapters, normalize, radar, series, spectral
from cellwave.operators.adapters import InputContract
from cellwave.plans.compose import Step, compose, step


@dataclass(frozen=True)
class TemplateStep:
    run: Callable[..., Signal]
    params: Mapping[str, Any] = field(default_factory=dict)
    enabled_if: Any = True


@dataclass(frozen=True)
class Variant:
    contract: InputContract
    steps: Sequence[TemplateStep]


@dataclass(frozen=True)
class Template:
    defaults: Mapping[str, Any]
    variants: Mapping[str, Variant]


def filled(value: Any, context: Mapping[str, Any]) -> Any:
    """A value with every ``$a.b`` in it replaced; an unknown path raises."""
    if isinstance(value, str) and value.startswith("$"):
        found: Any = context
        for part in value[1:].split("."):
            if not isinstance(found, Mapping) or part not in found:
                raise KeyError(f"no parameter {value!r} among {sorted(context)}")
            found = found[part]
        return found
    if isinstance(value, Mapping):
        return {k: filled(v, context) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(filled(v, context) for v in value)
    return value


def choose_variant(template: Template, contract: InputContract) -> str:
    """The one variant whose axes and value kind are the contract's and whose fixed sizes allow it."""

    def fits(own: InputContract) -> bool:
        same = tuple(own.axes) == tuple(contract.axes) and own.dtype_kind == contract.dtype_kind
        return same and all(contract.fixed_sizes.get(a, n) == n for a, n in own.fixed_sizes.items())

    names = [name for name, v in template.variants.items() if fits(v.contract)]
    if len(names) != 1:
        raise ValueError(f"{len(names)} of the variants {sorted(template.variants)} end in {contract}")
    return names[0]


def resolved_steps(template: Template, variant: str, contract: InputContract | None = None, **params: Any) -> list[tuple[Callable, dict]]:
    """Operators and parameters of the variant's enabled steps."""
    if variant not in template.variants:
        raise KeyError(f"no variant {variant!r} among {sorted(template.variants)}")
    chosen = template.variants[variant]
    unknown = sorted(set(params) - set(template.defaults))
    if unknown:
        raise KeyError(f"no parameters {unknown} among {sorted(template.defaults)}")
    context = {**template.defaults, **params, "output_contract": contract or chosen.contract}
    return [(s.run, filled(s.params, context)) for s in chosen.steps if filled(s.enabled_if, context)]


def build(template: Template, contract: InputContract | None = None, variant: str | None = None, **params: Any) -> Step:
    """One composed step. Without a variant and a contract the template must have a single variant."""
    if variant is None and contract is None and len(template.variants) == 1:
        variant = next(iter(template.variants))
    if variant is None:
        if contract is None:
            raise ValueError(f"name one of the variants {sorted(template.variants)} or a contract")
        variant = choose_variant(template, contract)
    return compose(*(step(run, **own) for run, own in resolved_steps(template, variant, contract, **params)))


def except_readers(fn: Callable[..., Signal]) -> Callable[..., Signal]:
    """The operator for samples of other readers than ``skip_reader_ids``, whose samples pass unchanged."""

    @wraps(fn)
    def run(sig: Signal, skip_reader_ids: Sequence[str] = (), **params: Any) -> Signal:
        if not skip_reader_ids:
            return fn(sig, **params)
        listed = F.coalesce(F.col("reader_id").isin(list(skip_reader_ids)), F.lit(False))
        skipped = sig.samples.where(listed).select(KEY)
        done = fn(sig.with_cells(null_safe(sig.cells, skipped, [KEY], "left_anti")), **params)
        same = sig.with_cells(null_safe(sig.cells, skipped, [KEY], "left_semi"))
        sizes = {a: n if sig.sizes.get(a) == n else None for a, n in done.sizes.items()}
        return replace(done.with_cells(done.cells.unionByName(same.cells.select(done.cells.columns)), sizes=sizes), coords=done.coords)

    return run


SEQUENCE = InputContract(("time", "feature"))
IMAGE = InputContract(("channel", "height", "width"))
COMPLEX_IMAGE = InputContract(("channel", "height", "width"), "complex")
VIDEO = InputContract(("time", "channel", "height", "width"))

# Cut-offs and orders of the published chains.
BAND_PASS = {"lowpass_hz": 60.0, "highpass_hz": 2.0, "lowpass_order": 6, "highpass_order": 3}


def cleaned(skip: Any = None) -> list[TemplateStep]:
    """Subcarrier L1, adjacent receivers' conjugate product and the band pass."""
    band = {k: f"$band_pass.{k}" for k in BAND_PASS} | {"sample_rate": "$sample_rate"}
    if skip is None:
        return [TemplateStep(normalize.subcarrier_l1), TemplateStep(series.adjacent_rx_conjugate), TemplateStep(series.temporal_filter, band)]
    listed = {"skip_reader_ids": skip}
    return [
        TemplateStep(normalize.subcarrier_l1, listed),
        TemplateStep(except_readers(series.adjacent_rx_conjugate), listed),
        TemplateStep(except_readers(series.temporal_filter), band | listed),
    ]


def _sequence(skip: Any = None) -> Variant:
    return Variant(SEQUENCE, [
        *cleaned(skip),
        TemplateStep(normalize.amplitude_phase),
        TemplateStep(normalize.sample_zscore, {"exclude_axes": ["feature"]}, "$sample_zscore"),
        TemplateStep(adapters.auto_align, {
            "contract": "$output_contract", "time_axis": "time", "flatten_axes": ("subc", "tx", "rx", "feature"), "value": "identity",
        }),
    ])


def _spectrum(contract: InputContract, aligned: Mapping[str, Any], *between: TemplateStep) -> Variant:
    return Variant(contract, [
        *cleaned(),
        TemplateStep(spectral.dense_doppler, {
            k: f"${k}" for k in ("sample_rate", "window_size", "window_step", "nfft", "max_doppler_hz", "target_time_bins")
        }),
        TemplateStep(normalize.sample_zscore, {}, "$sample_zscore"),
        *between,
        TemplateStep(adapters.auto_align, {"contract": "$output_contract", "value": "identity", **aligned}),
    ])


# The published lattice of links, subcarriers, frequency and time bins, and which of it is kept.
LATTICE = {"link": 4, "subcarrier": 2119, "freq": 121, "time": 1500}
KEPT = {
    "link": [0, 1, 2],
    "subcarrier": [
        2062, 2064, 2066, 2068, 2070, 2072, 2074, 2076, 2078, 2080, 2082, 2084, 2086, 2088, 2089,
        2091, 2093, 2095, 2097, 2099, 2101, 2103, 2105, 2107, 2109, 2111, 2113, 2115, 2117, 2118,
    ],
}
_PLANES = {"channel_axes": ("subc", "link"), "height_axis": "time_bin", "width_axis": "freq_bin"}
_PROJECTED = TemplateStep(
    normalize.polar_projection, {"totals": "$lattice.totals", "selected": "$lattice.kept", "apply_phase": "$apply_phase"}
)

#: Dense Doppler spectra as images, image sequences or CSI sequences.
DENSE_SPECTRUM = Template(
    {
        "sample_rate": 1000, "window_size": 256, "window_step": 10, "nfft": 1000, "max_doppler_hz": 60, "target_time_bins": None,
        "sample_zscore": True, "apply_phase": True, "band_pass": BAND_PASS, "lattice": {"totals": LATTICE, "kept": KEPT},
    },
    {
        "image_complex": _spectrum(COMPLEX_IMAGE, _PLANES, _PROJECTED),
        "image_real": _spectrum(IMAGE, _PLANES),
        "video_real": _spectrum(VIDEO, {"axis_map": {"time": "time_bin", "channel": ("link",), "height": "freq_bin", "width": "subc"}}),
        "sequence_real": _sequence(),
    },
)
#: Amplitude and phase sequences; listed readers pass the cleaning unchanged.
CSI_SEQUENCE = Template(
    {"sample_rate": 1000, "skip_reader_ids": (), "sample_zscore": False, "band_pass": BAND_PASS},
    {"sequence_real": _sequence("$skip_reader_ids")},
)
#: The same without readers to skip.
GAIT_SEQUENCE = Template({"sample_rate": 1000, "sample_zscore": False, "band_pass": BAND_PASS}, {"sequence_real": _sequence()})
#: Range, Doppler and angle transforms.
RADAR_CUBE = Template(
    {"range_window": "hann", "doppler_window": "hann", "num_bins": 64},
    {
        "cube": Variant(InputContract(("doppler", "range", "angle"), "complex"), [
            TemplateStep(radar.range_fft, {"axis": "adc", "window": "$range_window"}),
            TemplateStep(radar.doppler_fft, {"axis": "chirp", "window": "$doppler_window"}),
            TemplateStep(radar.angle_fft, {"axis": "ant", "num_bins": "$num_bins"}),
        ])
    },
)
