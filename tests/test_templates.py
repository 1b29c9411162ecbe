"""Preset templates: how they resolve, and their registered queries against plain numpy."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from cellwave.functions.kernels import butterworth
from cellwave.operators import normalize, series, spectral
from cellwave.operators.adapters import InputContract
from cellwave.plans import templates
from cellwave.workload import all_queries
from cellwave.workload.adapters import SPECTRUM

FOLDER = "/root/testdata/sf0.001"


def test_placeholders():
    context = {"a": {"b": {"c": 3}}, "d": [1], "e": False}
    assert templates.filled({"x": "$a.b.c", "y": ["$d", "plain"], "z": ("$e",)}, context) == {"x": 3, "y": [[1], "plain"], "z": (False,)}
    with pytest.raises(KeyError, match="no parameter"):
        templates.filled("$a.q", context)


def test_variants_are_found_by_contract():
    choose = templates.choose_variant
    assert choose(templates.DENSE_SPECTRUM, templates.COMPLEX_IMAGE) == "image_complex"
    assert choose(templates.DENSE_SPECTRUM, InputContract(("channel", "height", "width"), fixed_sizes={"height": 9})) == "image_real"
    assert choose(templates.DENSE_SPECTRUM, templates.VIDEO) == "video_real"
    assert choose(templates.CSI_SEQUENCE, templates.SEQUENCE) == "sequence_real"
    with pytest.raises(ValueError, match="0 of the variants"):
        choose(templates.CSI_SEQUENCE, templates.IMAGE)


def test_switches_and_overrides():
    steps = templates.resolved_steps(templates.CSI_SEQUENCE, "sequence_real", sample_rate=250)
    assert [f.__name__ for f, _ in steps] == ["subcarrier_l1", "adjacent_rx_conjugate", "temporal_filter", "amplitude_phase", "auto_align"]
    assert steps[2][1] == {**templates.BAND_PASS, "sample_rate": 250, "skip_reader_ids": ()}
    assert steps[-1][1]["contract"] == templates.SEQUENCE
    more = templates.resolved_steps(templates.CSI_SEQUENCE, "sequence_real", sample_zscore=True)
    assert (normalize.sample_zscore, {"exclude_axes": ["feature"]}) in more
    image = templates.resolved_steps(templates.DENSE_SPECTRUM, "image_complex")
    assert [f for f, _ in image][3:6] == [spectral.dense_doppler, normalize.sample_zscore, normalize.polar_projection]
    assert image[5][1]["totals"]["subcarrier"] == 2119 and len(image[5][1]["selected"]["subcarrier"]) == 30
    assert [f for f, _ in templates.resolved_steps(templates.GAIT_SEQUENCE, "sequence_real")][2] is series.temporal_filter
    with pytest.raises(KeyError, match="no parameters"):
        templates.build(templates.CSI_SEQUENCE, cutoff=3)
    with pytest.raises(ValueError, match="name one"):
        templates.build(templates.DENSE_SPECTRUM)


# ---- the chains in numpy


def captures():
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    ids, values = np.array(table["vec_id"]), np.array(table["embedding"].to_pylist(), float)
    cells = (values[:, 0::2] + 1j * values[:, 1::2]).reshape(-1, 4, 2, 4)  # time, rx, subc
    out = {}
    for k in np.argsort(ids):
        out.setdefault(int(ids[k]) % 25, []).append(cells[k].transpose(0, 2, 1))
    return {k: np.concatenate(v) for k, v in out.items()}


def reader(k):
    return f"reader{k % 3}"


def one_way(x, b, a):
    """Direct form, one sample at a time, from the state of an endless first sample."""
    past_x, past_y = [x[0]] * (len(b) - 1), [x[0] * b.sum() / a.sum()] * (len(a) - 1)
    out = []
    for v in x:
        y = b[0] * v + sum(c * p for c, p in zip(b[1:], past_x)) - sum(c * p for c, p in zip(a[1:], past_y))
        out.append(y)
        past_x, past_y = [v, *past_x[:-1]], [y, *past_y[:-1]]
    return np.array(out)


def band_pass(x, rate, lowpass_hz, highpass_hz, lowpass_order, highpass_order):
    for b, a in (butterworth(lowpass_order, lowpass_hz, rate, "low"), butterworth(highpass_order, highpass_hz, rate, "high")):
        edge = 3 * len(a)
        y = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
        x = one_way(one_way(y, b, a)[::-1], b, a)[::-1][edge:-edge]
    return x


def clean(x, rate, band):
    x = x / np.abs(x).sum(1, keepdims=True)
    x = (x[:, :, 0] * x[:, :, 1].conj())[:, :, None]
    return np.stack([band_pass(x[:, s, 0], rate, **band) for s in range(x.shape[1])], 1)[:, :, None]


def rows_of(spark, name, *axes):
    got = {}
    for r in all_queries()[name](spark, FOLDER).collect():
        got.setdefault(r.sample_id, {})[tuple(r[a] for a in axes)] = complex(r.re, r.im) if "re" in r.__fields__ else r.value
    return got


def close(got, want):
    assert got.keys() == set(np.ndindex(want.shape))
    assert max(abs(got[k] - want[k]) for k in got) < 3e-5


def test_wifi_preprocess_at_full_orders(spark):
    got = rows_of(spark, "wifi_preprocess", "time", "subc", "tx", "rx")
    for k, x in captures().items():
        if reader(k) == "reader1":  # its subcarriers are not scaled
            y = (x[:, :, 0] * x[:, :, 1].conj())[:, :, None]
            y = np.stack([band_pass(y[:, s, 0], 1000, **templates.BAND_PASS) for s in range(4)], 1)[:, :, None]
        else:
            y = clean(x, 1000, templates.BAND_PASS)
        close(got[k], y[:, :, None])


def sequence(y):
    both = np.stack([np.abs(y), np.angle(y)], -1)
    axes = tuple(range(both.ndim - 1))
    both = (both - both.mean(axes)) / both.std(axes, ddof=1) if both.size > 2 else both
    return both.reshape(len(both), -1)


def test_sequences(spark):
    preset, template = (rows_of(spark, n, "time", "feature") for n in ("csi_sequence_preset", "csi_sequence_template"))
    for k, x in captures().items():
        y = clean(x, 1000, templates.BAND_PASS)
        close_angles(preset[k], sequence(y[:, :, None]))
        close_angles(template[k], sequence((x if reader(k) == "reader1" else y)[:, :, None]))


def close_angles(got, want):
    """Phases next to the cut may fall on either side of it."""
    assert got.keys() == set(np.ndindex(want.shape))
    far = sum(abs(got[k] - want[k]) > 3e-5 for k in got)
    assert far <= 1e-4 * len(got)


def test_spectra(spark):
    got = rows_of(spark, "dense_spectrum_template", "channel", "height", "width")
    w = {k: v for k, v in SPECTRUM.items() if k != "band_pass"}
    kept, totals = [1, 2, 5, 8], {"link": 2, "subcarrier": 9, "freq": 13, "time": 5000}
    shape = np.exp(-0.5 * ((np.arange(16) - 8.0) / 16) ** 2)
    window = np.pad(shape, (12, 12))
    bins = [k if k <= 6 else k + 40 - 13 for k in range(13)]
    for k, x in captures().items():
        y = clean(x, 40, SPECTRUM["band_pass"])[:, :, 0]
        y = np.pad(y - y.mean(0), ((20, 20), (0, 0)))
        frames = np.stack([y[a : a + 40] for a in range(0, len(y) - 39, w["window_step"])])
        spectrum = np.abs(np.fft.fft(frames * window[None, :, None], axis=1))[:, bins] / shape.sum()
        spectrum = np.roll(spectrum, 6, 1)
        spectrum = (spectrum - spectrum.mean()) / spectrum.std(ddof=1)  # time, freq, subc
        flat = np.ravel_multi_index(
            (np.full(spectrum.shape, 1), *np.broadcast_arrays(
                np.array(kept)[None, None, :], np.arange(13)[None, :, None], np.arange(len(spectrum))[:, None, None])),
            (totals["link"], totals["subcarrier"], totals["freq"], totals["time"]),
        )
        z = spectrum * np.exp(1j * np.pi * flat / (np.prod(list(totals.values())) - 1))
        close(got[k], z.transpose(2, 0, 1))
