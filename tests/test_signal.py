"""Signal operators against direct numpy on small arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwave.functions import kernels
from cellwave.model import Signal
from cellwave.operators import axes, normalize, radar, series, spectral

RNG = np.random.default_rng(5)


def to_signal(spark, arrays, names):
    """One sample per array."""
    rows = []
    for s, a in enumerate(arrays):
        for idx in np.ndindex(a.shape):
            v = a[idx]
            rows.append((s, *map(int, idx), *((float(v.real), float(v.imag)) if np.iscomplexobj(a) else (float(v),))))
    value = "re double, im double" if np.iscomplexobj(arrays[0]) else "value double"
    schema = ", ".join(["sample_id bigint", *(f"{n} bigint" for n in names), value])
    return Signal(spark.createDataFrame(rows, schema).repartition(5), tuple(names))


def to_arrays(sig):
    rows = sig.cells.collect()
    out = {}
    for s in sorted({r.sample_id for r in rows}, key=str):
        mine = [r for r in rows if r.sample_id == s]
        shape = [max(r[a] for r in mine) + 1 for a in sig.axes]
        a = np.full(shape, np.nan, dtype=complex if sig.is_complex else float)
        for r in mine:
            a[tuple(r[x] for x in sig.axes)] = complex(r.re, r.im) if sig.is_complex else r.value
        assert len(mine) == a.size and not np.isnan(a).any()
        out[s] = a
    return list(out.values())


def noise(*shape, real=False):
    x = RNG.normal(size=shape)
    return x if real else x + 1j * RNG.normal(size=shape)


def check(sig, wanted, tol=1e-9):
    for got, want in zip(to_arrays(sig), wanted, strict=True):
        assert got.shape == want.shape
        np.testing.assert_allclose(got, want, atol=tol, rtol=1e-7)


# --- filters -----------------------------------------------------------------


def direct_lfilter(x, b, a, state):
    state, out = state.astype(complex).copy(), np.empty(len(x), dtype=complex)
    for i, v in enumerate(x):
        out[i] = b[0] * v + state[0]
        shifted = np.append(state[1:], 0)
        state = shifted + b[1:] * v - a[1:] * out[i]
    return out


def direct_filtfilt(x, b, a):
    edge = 3 * len(a)
    ext = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    order = len(a) - 1
    companion = np.zeros((order, order))
    companion[0] = -a[1:]
    companion[1:, :-1] += np.eye(order - 1)
    settled = np.linalg.solve(np.eye(order) - companion.T, b[1:] - a[1:] * b[0])
    y = direct_lfilter(ext, b, a, settled * ext[0])[::-1]
    return direct_lfilter(y, b, a, settled * y[0])[::-1][edge:-edge]


def test_butterworth_gains():
    for order in (1, 3, 6):
        b, a = kernels.butterworth(order, 60.0, 1000.0, "low")
        z = np.exp(1j * 2 * np.pi * 60 / 1000)
        assert abs(abs(np.polyval(b, z) / np.polyval(a, z)) - 2**-0.5) < 1e-9
        assert abs(b.sum() / a.sum() - 1) < 1e-9
        h, g = kernels.butterworth(order, 60.0, 1000.0, "high")
        assert abs(np.polyval(h, -1.0) / np.polyval(g, -1.0) - 1) < 1e-9
        assert abs(abs(np.polyval(h, z) / np.polyval(g, z)) - 2**-0.5) < 1e-9
    with pytest.raises(ValueError):
        kernels.butterworth(2, 500.0, 1000.0, "low")


@pytest.mark.parametrize("chunk", [None, 400])
def test_temporal_filter_whole_and_chunked(spark, chunk):
    x = [noise(1500, 2), noise(700, 2)]
    args = dict(sample_rate=200, lowpass_hz=30.0, highpass_hz=4.0, lowpass_order=4, highpass_order=2)
    out = series.temporal_filter(to_signal(spark, x, ["time", "rx"]), **args, chunk=chunk)
    stages = [kernels.butterworth(4, 30.0, 200, "low"), kernels.butterworth(2, 4.0, 200, "high")]

    def whole(column):
        for b, a in stages:
            column = direct_filtfilt(column, b, a)
        return column

    check(out, [np.apply_along_axis(whole, 0, a) for a in x], 1e-9)


def test_filter_needs_enough_samples(spark):
    sig = to_signal(spark, [noise(8, 1)], ["time", "rx"])
    with pytest.raises(Exception, match="not longer than the padding"):
        series.temporal_filter(sig, 100, 20.0, 2.0, 2, 1).cells.collect()


# --- series ------------------------------------------------------------------


def direct_hampel(x, half, threshold):
    out = x.copy()
    for i in range(len(x)):
        w = x[max(0, i - half) : i + half + 1]
        mag = np.sort(np.abs(w))
        med = mag[(len(w) - 1) // 2]
        mad = np.sort(np.abs(mag - med))[(len(w) - 1) // 2]
        if abs(abs(x[i]) - med) > threshold * 1.4826 * mad:
            out[i] = w[np.argsort(np.abs(w))[len(w) // 2]]
    return out


@pytest.mark.parametrize("chunk", [None, 7, 16])
def test_hampel(spark, chunk):
    x = [noise(60), noise(1), noise(5)]
    out = series.hampel_filter(to_signal(spark, x, ["time"]), "time", 7, 1.5, chunk=chunk)
    check(out, [direct_hampel(a, 3, 1.5) for a in x])
    with pytest.raises(ValueError, match="odd"):
        series.hampel_filter(out, "time", 4)


@pytest.mark.parametrize("chunk", [None, 9])
def test_unwrap_matches_numpy(spark, chunk):
    x = [np.cumsum(noise(80, real=True)) * 2 % 6.0]
    out = series.phase_unwrap(to_signal(spark, x, ["time"]), "time", chunk=chunk)
    check(out, [np.unwrap(a) for a in x])
    steps = np.diff(to_arrays(out)[0])
    assert np.abs(steps).max() <= np.pi + 1e-9


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_pilot_interpolation_is_exact_on_polynomials(spark, method):
    i = np.arange(20.0)
    x = [np.stack([3 * i + 1, (i**3 if method == "cubic" else -i) + 2])]
    broken = [x[0].copy()]
    broken[0][:, [0, 6, 7, 13, 19]] = 99.0
    sig = to_signal(spark, broken, ["rx", "subc"])
    check(series.pilot_interpolate(sig, [0, 6, 7, 13, 19, 40], 20, method=method), x, 1e-8)


def test_adjacent_conjugate_cases(spark):
    one, three = noise(4, 1), noise(4, 3)
    sig = to_signal(spark, [one], ["time", "rx"])
    check(series.adjacent_rx_conjugate(sig), [one])
    out = series.adjacent_rx_conjugate(to_signal(spark, [three], ["time", "rx"]))
    check(out, [three * np.conj(np.roll(three, -1, axis=1))])


def test_csi_ratio_guards_zero(spark):
    x = noise(3, 2)
    x[1, 1] = 0
    out = series.csi_ratio(to_signal(spark, [x], ["time", "rx"]), 0, 1)
    den = np.where(np.abs(x[:, 1]) < 1e-10, 1e-10, x[:, 1])
    check(out, [x[:, 0] / den])


def test_zero_energy_arrival(spark):
    sig = to_signal(spark, [np.zeros((1, 6), dtype=complex)], ["time", "tap"])
    sig = Signal(sig.cells, sig.axes, spark.createDataFrame([(0, 1e9)], "sample_id bigint, bandwidth double"))
    row = series.time_of_arrival(sig).collect()[0]
    assert (row.tap_index, row.toa, row.range_m) == (0, 0.0, 0.0)


def test_frame_groups_clamp(spark):
    out = to_arrays(series.frame_groups(to_signal(spark, [np.arange(5.0)], ["frame"]), 4))[0]
    want = [[max(0, min(4, t - 2 + g)) for g in range(4)] for t in range(5)]
    np.testing.assert_array_equal(out, want)


def test_channel_hops_with_few_and_many_channels(spark):
    for n in (8, 45):
        out = to_arrays(series.channel_hop_reorder(to_signal(spark, [np.arange(float(n))], ["channel"])))[0]
        listed = [h for h in series.BLE_HOPS if h < n]
        assert list(out) == listed + [c for c in range(n) if c not in listed]


def test_segments_drop_empty(spark):
    sig = to_signal(spark, [np.arange(50.0)], ["time"])
    notes = spark.createDataFrame(
        [(0, 1, 5, 5), (0, 2, 9, 3), (0, 3, 10, 13), (0, 4, 0, 50)],
        "sample_id bigint, segment int, `start` bigint, `end` bigint",
    )
    rows = series.extract_segments(sig, notes, span=8).cells.collect()
    assert sorted((r.time, r.value) for r in rows if r.segment == 3) == [(0, 10.0), (1, 11.0), (2, 12.0)]
    assert sum(r.segment == 4 for r in rows) == 50 and {r.segment for r in rows} == {3, 4}


# --- spectral ----------------------------------------------------------------


def test_fft_round_trip_and_parseval(spark):
    x = [noise(12, 3), noise(7, 3)]
    sig = to_signal(spark, x, ["time", "rx"])
    freq = spectral.fft(sig)
    check(freq, [np.fft.fft(a, axis=0, norm="ortho") for a in x])
    check(spectral.inverse_fft(freq), x)
    energy = lambda s: s.cells.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0]
    assert abs(energy(sig) - energy(freq)) < 1e-9


def direct_stft(x, n, hop, window, mode):
    p = np.pad(x, n // 2, mode="reflect" if mode == "reflect" else "constant") if mode else x
    frames = [p[i : i + n] * window for i in range(0, len(p) - n + 1, hop)]
    return np.stack(frames, axis=1)


@pytest.mark.parametrize("hop,span", [(4, 8192), (4, 24), (5, 10), (20, 40)])
@pytest.mark.parametrize("center", [True, False])
def test_stft(spark, hop, span, center):
    x = [noise(100), noise(61)]
    out = spectral.stft(to_signal(spark, x, ["time"]), n_fft=16, hop=hop, center=center, span=span)
    window = kernels.periodic_window("hann", 16)
    mode = "reflect" if center else None
    check(out, [np.fft.fft(direct_stft(a, 16, hop, window, mode), axis=0) for a in x])


def test_stft_short_window_onesided(spark):
    x = [noise(64, real=True)]
    out = spectral.stft(to_signal(spark, x, ["time"]), n_fft=16, win_length=10, normalized=True)
    window = np.pad(kernels.periodic_window("hann", 10), 3)
    check(out, [np.fft.rfft(direct_stft(a, 16, 4, window, "reflect"), axis=0) / 4 for a in x])


def test_dense_doppler(spark):
    x = [noise(50, 2, 2, 3)]
    out = spectral.dense_doppler(to_signal(spark, x, ["time", "subc", "tx", "rx"]), 32, 12, 4, 32, 5, span=16)
    window = np.pad(kernels.gaussian_window(12, 12.0), 10)
    freqs = np.fft.fftfreq(32, 1 / 32)
    picked = np.roll(np.flatnonzero(np.abs(freqs) <= 5), 5)
    a = x[0] - x[0].mean(axis=0)
    want = np.zeros((13, 11, 2, 6))
    for s, tx, rx in np.ndindex(2, 2, 3):
        spec = np.fft.fft(direct_stft(a[:, s, tx, rx], 32, 4, window, "constant"), axis=0)
        want[:, :, s, rx * 2 + tx] = np.abs(spec[picked]).T / window.sum()
    check(out, [want])
    assert spectral.doppler_bins(32, 32, 5) == [-5.0, -4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("chunk", [10, 65536])
def test_autocorrelation(spark, chunk):
    x = [noise(37, real=True), noise(4, real=True)]
    out = spectral.autocorrelation(to_signal(spark, x, ["time"]), max_lag=6, normalized=False, chunk=chunk)
    check(out, [np.array([a[: len(a) - k] @ a[k:] for k in range(min(6, len(a) - 1) + 1)]) for a in x])


@pytest.mark.parametrize("chunk", [16, 65536])
def test_scalogram(spark, chunk):
    x = [noise(60, real=True)]
    out = spectral.wavelet_scalogram(to_signal(spark, x, ["time"]), 50.0, num_frequencies=3, min_hz=4.0, cycles=3.0, chunk=chunk)
    want = []
    for _, c, s in spectral.wavelet_kernels(50.0, 3, 4.0, None, 3.0):
        half = len(c) // 2
        full = [np.correlate(np.pad(x[0], half), k, "valid") for k in (c, s)]
        want.append(np.hypot(*full))
    check(out, [np.stack(want)])


# --- radar -------------------------------------------------------------------


def test_radar_cube_equals_three_steps(spark):
    x = [noise(2, 6, 8, 3)]
    sig = to_signal(spark, x, ["frame", "chirp", "adc", "ant"])
    steps = radar.angle_fft(radar.doppler_fft(radar.range_fft(sig)), num_bins=5)
    check(axes.permute(radar.radar_cube(sig, 5), "frame", "doppler", "range", "angle"), to_arrays(steps))


def test_music_finds_the_source(spark):
    places = np.array([0.0, 0.03, 0.06, 0.09])
    truth, wavelength = 20.0, 299792458.0 / 5e9
    steer = np.exp(-2j * np.pi / wavelength * np.sin(np.deg2rad(truth)) * places)
    x = noise(40)[:, None] * steer + 0.01 * noise(40, 4)
    sig = to_signal(spark, [x], ["snapshot", "sensor"])
    out = to_arrays(radar.music_spectrum(sig, "aoa", "sensor", "snapshot", 1, positions=list(places), center_freq=5e9))[0]
    assert abs(np.linspace(-90, 90, 181)[out.argmax()] - truth) <= 1
    cov = x.T @ x.conj() / 40
    noise_space = np.linalg.eigh(cov)[1][:, :3]
    grid = np.deg2rad(np.linspace(-90, 90, 181))
    a = np.exp(-2j * np.pi / wavelength * np.sin(grid)[:, None] * places)
    want = [1 / max(np.linalg.norm(noise_space.conj().T @ v) ** 2, 1e-8) for v in a]
    np.testing.assert_allclose(out, want, rtol=1e-5)
    with pytest.raises(ValueError, match="num_sources"):
        radar.music_spectrum(sig, "aoa", "sensor", "snapshot", 4, positions=list(places), center_freq=5e9)


def test_heatmap_cell_by_cell(spark):
    ants, chirps, samples, azimuth, elevation = 4, 12, 16, 8, 4
    bins = list(range(11, 3, -1))
    x = noise(ants, chirps, samples)
    out = to_arrays(radar.elevation_azimuth_heatmap(
        to_signal(spark, [x], ["ant", "chirp", "adc"]), azimuth, elevation, bins, group_chirps=2
    ))[0]
    steps = chirps // 3
    look = [x[:, k::3] - x[:, k::3].mean(axis=1, keepdims=True) for k in range(3)]
    w = lambda n, k, m: np.exp(-2j * np.pi * k * m / n)
    want = np.zeros((2, len(bins), azimuth, elevation), dtype=complex)
    rd = [np.zeros((ants, steps, samples), dtype=complex) for _ in range(3)]
    for k in range(3):
        for r in range(ants):
            rd[k][r] = np.fft.fft(np.fft.fft(look[k][r], axis=0), axis=1)
    for g, d in enumerate([1, 2]):
        doppler = (d + steps // 2) % steps
        for n, b in enumerate(bins):
            grid = np.zeros((elevation, azimuth), dtype=complex)
            grid[0, :4], grid[0, 4:8], grid[1, 2:6] = rd[0][:, doppler, b], rd[2][:, doppler, b], rd[1][:, doppler, b]
            mixed = grid.copy()
            for a in (2, 3, 4, 5):
                for e in range(elevation):
                    mixed[e, a] = sum(grid[m, a] * w(elevation, e, m) for m in range(elevation))
            for e in range(elevation):
                for a in range(azimuth):
                    value = sum(mixed[e, m] * w(azimuth, a, m) for m in range(azimuth))
                    # centred, then reversed
                    want[g, n, azimuth - 1 - (a + azimuth // 2) % azimuth, elevation - 1 - (e + elevation // 2) % elevation] = value
    np.testing.assert_allclose(out, want, atol=1e-9)


# --- axes and normalisers ----------------------------------------------------


def test_normalisers_are_idempotent(spark):
    sig = to_signal(spark, [noise(4, 5), 3 * noise(4, 5)], ["time", "subc"])
    real = normalize.magnitude(sig)
    for fn, start in ((normalize.zscore, real), (normalize.l2, sig), (normalize.spatial_channels, None)):
        if start is None:
            start = to_signal(spark, [noise(2, 3, 4, real=True)], ["channel", "h", "w"])
        once = fn(start)
        check(fn(once), to_arrays(once), 1e-6)


def test_one_element_series(spark):
    complex_one = to_signal(spark, [noise(1)], ["time"])
    check(normalize.zscore(complex_one), [np.zeros(1, dtype=complex)])
    real_one = normalize.zscore(normalize.magnitude(complex_one)).cells.collect()
    assert real_one[0].value is None


def test_temporal_resize_edges(spark):
    x = [noise(5), noise(1)]
    sig = to_signal(spark, x, ["time"])
    for n in (1, 3, 5, 9):
        out = axes.temporal_resize(sig, "time", n)
        want = []
        for a in x:
            at = np.clip((np.arange(n) + 0.5) * len(a) / n - 0.5, 0, len(a) - 1)
            i = np.floor(at).astype(int)
            j = np.minimum(i + 1, len(a) - 1)
            want.append(a[i] + (a[j] - a[i]) * (at - i))
        check(out, want)
        corner = axes.temporal_resize(sig, "time", n, align_corners=True)
        grid = [np.linspace(0, len(a) - 1, n) if n > 1 else np.zeros(1) for a in x]
        check(corner, [np.interp(g, np.arange(len(a)), a.real) + 1j * np.interp(g, np.arange(len(a)), a.imag) for g, a in zip(grid, x)])


def test_rearrange_round_trip(spark):
    x = [noise(6, 4, real=True)]
    sig = to_signal(spark, x, ["time", "subc"])
    out = axes.rearrange(sig, "(a b) subc -> subc (b a)", a=2, b=3)
    check(out, [a.reshape(2, 3, 4).transpose(2, 1, 0).reshape(4, 6) for a in x])
    with pytest.raises(ValueError):
        axes.rearrange(sig, "time subc -> time")


def test_select_and_concat(spark):
    x = [noise(6, 3), noise(4, 3)]
    sig = to_signal(spark, x, ["time", "rx"])
    check(axes.select_index(sig, time=slice(-3, None), rx=-1), [a[-3:, -1] for a in x])
    check(axes.concat([sig, axes.select_index(sig, time=slice(1, 3))], "time"), [np.concatenate([a, a[1:3]]) for a in x])


def test_missing_axis_is_an_error(spark):
    sig = to_signal(spark, [noise(3)], ["time"])
    with pytest.raises(ValueError, match="not found"):
        series.phase_calibration(sig)
    with pytest.raises(ValueError, match="complex"):
        normalize.magnitude(normalize.magnitude(sig))


@pytest.mark.parametrize("max_group", [8, 1 << 16])
def test_long_fft(spark, max_group):
    x = [noise(n, 2) for n in (1, 2, 12, 37, 64, 94)]
    sig = to_signal(spark, x, ["time", "rx"])
    freq = spectral.fft_long(sig, max_group=max_group)
    check(freq, [np.fft.fft(a, axis=0, norm="ortho") for a in x])
    back = spectral.fft_long(sig, norm="backward", inverse=True, max_group=max_group)
    check(back, [np.fft.ifft(a, axis=0) for a in x])


SIZED_CASES = {
    "negative_slice": lambda s: axes.select_index(s, time=slice(-5, -1, 2), rx=-1),
    "concat": lambda s: axes.concat([s, axes.select_index(s, time=slice(0, 3))], "time"),
    "crop": lambda s: axes.resize_axis(s, "time", 5, crop="center"),
    "pad": lambda s: axes.resize_axis(s, "time", 17),
    "resize": lambda s: axes.temporal_resize(s, "time", 7),
    "merge": lambda s: axes.merge_axes(s, ["subc", "rx"], "f"),
    "rearrange": lambda s: axes.rearrange(s, "time subc rx -> rx (subc time)"),
    "conjugate": series.adjacent_rx_conjugate,
    "doppler": lambda s: spectral.dense_doppler(axes.repeat(s, "tx", 1), 16, 4, 2, 8, 3, target_time_bins=4),
    "stft": lambda s: spectral.stft(s, n_fft=4),
    "center": lambda s: series.center_frames(s, 4, axis="time", new_axis="frame"),
    "long": lambda s: spectral.fft_long(s, max_group=4),
    "phase": lambda s: normalize.amplitude_phase(s, unwrap_axis="subc"),
}


@pytest.mark.parametrize("case", sorted(SIZED_CASES))
def test_declared_sizes_change_nothing(spark, case):
    x = [noise(12, 3, 2), noise(12, 3, 2)]
    plain = to_signal(spark, x, ["time", "subc", "rx"])
    declared = Signal(plain.cells, plain.axes, sizes={"time": 12, "subc": 3, "rx": 2})
    a, b = SIZED_CASES[case](plain), SIZED_CASES[case](declared)
    assert a.axes == b.axes
    got = to_arrays(b)
    check(a, got)
    for axis, n in b.sizes.items():
        assert {g.shape[b.axes.index(axis)] for g in got} == {n}, axis


def test_long_autocorrelation_equals_packed(spark):
    x = [noise(14, real=True), noise(5, real=True)]
    sig = to_signal(spark, x, ["time"])
    packed = spectral.autocorrelation(sig)
    check(spectral.autocorrelation(sig, long_series=True), to_arrays(packed))


def test_short_series_give_no_frames(spark):
    sig = to_signal(spark, [np.arange(8.0)], ["time"])
    for center in (True, False):
        assert spectral.stft(sig, n_fft=64, center=center).cells.count() == 0
        assert [r.length for r in spectral.short_series(sig, n_fft=64, center=center).collect()] == [8]
    with pytest.raises(ValueError, match="too short"):
        spectral.require_frames(sig, n_fft=64)
    assert spectral.short_series(sig, n_fft=8).count() == 0
