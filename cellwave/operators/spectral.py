"""Spectral operators.

Series of bounded axes are packed to arrays and transformed in Arrow batches;
long time axes are packed per chunk with the halo a frame or lag needs, so no
task holds a whole capture.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwave.functions.columns import SPEED_OF_SOUND
from cellwave.functions.kernels import array_kernel, gaussian_window, periodic_window
from cellwave.model import KEY, Signal
from cellwave.operators.axes import axis_lengths, pack_series, with_lengths
from cellwave.operators.ordinal import with_halo
from cellwave.operators.packed import with_statistics

#: Series of declared sizes up to this meet all their lags as products in the JVM.
SHORT_LAGS = 32


def map_series(
    sig: Signal, axis: str, kernel: Callable, new_axis: str, real: bool = False, flags: dict[str, Column] | None = None
) -> Signal:
    """Pack one axis, run a kernel on the arrays, unpack to a new axis in place.

    ``flags`` are per-sample columns of ``samples`` passed to the kernel.
    """
    sig.require(axis)
    packed = pack_series(sig, axis)
    flags = flags or {}
    if flags:
        packed = packed.join(sig.samples.select(KEY, *(c.alias(n) for n, c in flags.items())), on=KEY)
    result = array_kernel(kernel, sig.parts, *(F.col(n) for n in flags), real=real)
    names = [new_axis if a == axis else a for a in sig.axes]
    done = packed.select(*sig.keys(axis), result.alias("_y"))
    cells = _exploded(done, sig.keys(axis), new_axis, real)
    return replace(sig.with_cells(cells, names, {new_axis: None}), coords=None)


#: Most entries of a transform's table up to which cells meet it in the JVM.
TABLE_ENTRIES = 1 << 10


def transform_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """``_n, _k, _wr, _wi`` of a ``[length, bins]`` matrix, made in the JVM; at most ``TABLE_ENTRIES`` rows by choice."""
    flat, bins = matrix.astype(complex).ravel(), F.lit(matrix.shape[1])
    at = F.col("id")
    weights = [F.element_at(F.lit(part.tolist()), (at + 1).cast("int")).alias(n) for part, n in ((flat.real, "_wr"), (flat.imag, "_wi"))]
    return spark.range(0, len(flat), 1, 1).select(F.floor(at / bins).alias("_n"), F.pmod(at, bins).alias("_k"), *weights)


def join_table(sig: Signal, axis: str, matrix: np.ndarray, new_axis: str) -> Signal:
    """A linear transform of one axis as a join with its broadcast table and sums that tasks combine before they move."""
    table = transform_table(sig.cells.sparkSession, matrix)
    rows = sig.cells.join(F.broadcast(table), F.col(axis) == F.col("_n"))
    re = F.col("re") if sig.is_complex else F.col("value")
    real, imag = re * F.col("_wr"), re * F.col("_wi")
    if sig.is_complex:
        real, imag = real - F.col("im") * F.col("_wi"), imag + F.col("im") * F.col("_wr")
    cells = rows.groupBy(*sig.keys(axis), F.col("_k").alias(new_axis)).agg(F.sum(real).alias("re"), F.sum(imag).alias("im"))
    names = [new_axis if a == axis else a for a in sig.axes]
    return replace(sig.with_cells(cells, names, {new_axis: matrix.shape[1]}), coords=None)


def map_linear(sig: Signal, axis: str, kernel: Callable, new_axis: str, method: str = "auto") -> Signal:
    """A linear kernel of one axis: ``sql`` joins cells with the kernel's matrix, ``arrays`` runs it on packed series.

    ``auto`` takes ``sql`` where the axis has a declared size and its matrix at most ``TABLE_ENTRIES`` entries.
    """
    sig.require(axis)
    if method not in ("auto", "sql", "arrays"):
        raise ValueError(f"unknown method {method!r}")
    size = sig.sizes.get(axis)
    if method == "sql" and not size:
        raise ValueError(f"the sql method needs a declared size of {axis!r}")
    matrix = kernel(np.eye(size)) if size and method != "arrays" and (method == "sql" or size * size <= TABLE_ENTRIES) else None
    if matrix is not None and (method == "sql" or matrix.size <= TABLE_ENTRIES):
        return join_table(sig, axis, matrix, new_axis)
    return map_series(sig, axis, kernel, new_axis)


def _exploded(done: DataFrame, keys: Sequence[str], axis: str, real: bool) -> DataFrame:
    zipped = F.col("_y") if real else F.arrays_zip(F.col("_y.re").alias("re"), F.col("_y.im").alias("im"))
    cells = done.select(*keys, F.posexplode(zipped).alias("_i", "_c"))
    parts = [F.col("_c").alias("value")] if real else [F.col("_c.re"), F.col("_c.im")]
    return cells.select(*keys, F.col("_i").cast("bigint").alias(axis), *parts)


def fft(sig: Signal, axis: str = "time", norm: str = "ortho", new_axis: str = "freq", method: str = "auto") -> Signal:
    return map_linear(sig, axis, lambda x: np.fft.fft(x, axis=1, norm=norm), new_axis, method)


def inverse_fft(sig: Signal, axis: str = "freq", norm: str = "ortho", new_axis: str = "time", method: str = "auto") -> Signal:
    return map_linear(sig, axis, lambda x: np.fft.ifft(x, axis=1, norm=norm), new_axis, method)


def frequency(idx: Column, n: Column, rate: Column, onesided: bool = False) -> Column:
    """Unshifted FFT bin frequency."""
    step = rate / n
    return idx * step if onesided else F.when(idx < F.ceil(n / F.lit(2)), idx).otherwise(idx - n) * step


def frequency_coordinates(sig: Signal, n: int, axis: str = "freq", onesided: bool = False) -> DataFrame:
    """Coordinate rows of a frequency axis from ``samples.sample_rate``."""
    size = n // 2 + 1 if onesided else n
    rows = sig.samples.select(KEY, "sample_rate", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("idx"))
    value = frequency(F.col("idx"), F.lit(n), F.col("sample_rate"), onesided)
    return rows.select(
        KEY, F.lit(axis).alias("axis"), F.col("idx").cast("bigint").alias("idx"), value.alias("value"),
        F.lit("Hz").alias("unit"),
    )


def frame_coordinates(sig: Signal, frames: DataFrame, hop: int, axis: str = "frame") -> DataFrame:
    """Frame start times from the hop and ``samples.sample_rate``."""
    return frames.join(sig.samples.select(KEY, "sample_rate"), on=KEY).select(
        KEY, F.lit(axis).alias("axis"), F.col(axis).alias("idx"),
        (F.col(axis) * F.lit(hop) / F.col("sample_rate")).alias("value"), F.lit("s").alias("unit"),
    )


def short_series(
    sig: Signal, axis: str = "time", n_fft: int = 256, center: bool = True, pad_mode: str = "reflect",
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Sample and series keys with ``length`` where a series is too short for one frame."""
    pad = n_fft // 2 if center else 0
    rows = with_lengths(sig, axis, sizes=sizes).withColumn("length", F.col(f"_len_{axis}"))
    n = F.col("length")
    short = n + 2 * pad < n_fft
    if center and pad_mode == "reflect":
        short = short | (n <= pad)
    return rows.where(short).select(*sig.keys(axis), "length").distinct()


def require_frames(sig: Signal, axis: str = "time", n_fft: int = 256, center: bool = True, pad_mode: str = "reflect") -> None:
    """Raise when a series is too short for one frame."""
    found = short_series(sig, axis, n_fft, center, pad_mode).take(5)
    if found:
        raise ValueError(f"series too short for n_fft={n_fft}: {[r.asDict() for r in found]}")


def _framed(
    sig: Signal, axis: str, n_fft: int, hop: int, pad_mode: str | None, sizes: dict[str, int] | None, span: int
) -> tuple[DataFrame, int]:
    """Pack padded samples per chunk of frames: ``(keys, _chunk, _frames, re[], im[])``.

    Chunk c holds frames [c*k, c*k + k) and every sample they cover, zero
    where the padding is constant.
    """
    per_chunk = max(1, span // hop)
    pad = 0 if pad_mode is None else n_fft // 2
    rows = with_lengths(sig, axis, sizes=sizes)
    t, n = F.col(axis).cast("bigint"), F.col(f"_len_{axis}")
    places = [t + pad]
    if pad_mode == "reflect":
        places.append(F.when((t >= 1) & (t <= pad), pad - t))
        places.append(F.when((t >= n - 1 - pad) & (t <= n - 2), pad + 2 * (n - 1) - t))
    elif pad_mode not in (None, "constant"):
        raise ValueError(f"unknown pad mode {pad_mode!r}")
    rows = rows.withColumn("_q", F.explode(F.array_compact(F.array(*places))))
    frames = F.floor((n + 2 * pad - n_fft) / F.lit(hop)) + 1
    q = F.col("_q")
    last = F.least(frames - 1, F.floor(q / F.lit(hop)))
    first = F.least(last, F.greatest(F.lit(0), F.ceil((q - n_fft + 1) / F.lit(hop))))
    if pad_mode == "reflect":
        # a series can't be reflected further than it is long
        rows = rows.where(n > pad)
    # samples after the last frame belong to none
    rows = rows.withColumns({"_first": first, "_last": last, "_total": frames}).where(
        (F.col("_total") > 0) & (q < (F.col("_total") - 1) * F.lit(hop) + n_fft)
    )
    chunks = F.sequence(F.floor(F.col("_first") / F.lit(per_chunk)), F.floor(F.col("_last") / F.lit(per_chunk)))
    rows = rows.withColumn("_chunk", F.explode(chunks))
    base = F.col("_chunk") * F.lit(per_chunk * hop)
    keys = [*sig.keys(axis), "_chunk"]
    packed = rows.withColumn("_off", (q - base).cast("int")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_off", *sig.parts))).alias("_rows"), F.max("_total").alias("_total")
    )
    count = F.least(F.lit(per_chunk), F.col("_total") - F.col("_chunk") * F.lit(per_chunk)).cast("int")
    width = ((count - 1) * F.lit(hop) + n_fft).cast("int")

    def dense(part: str) -> Column:
        """Array over the chunk's whole width; constant padding has no rows."""
        lead = F.element_at("_rows._off", 1)
        inner = F.col(f"_rows.{part}")
        left = F.array_repeat(F.lit(0.0), lead)
        right = F.array_repeat(F.lit(0.0), width - lead - F.size(inner))
        return F.concat(left, inner, right).alias(part)

    return packed.select(*keys, count.alias("_frames"), *(dense(p) for p in sig.parts)), per_chunk


def _frame_view(x: np.ndarray, frames: int, n_fft: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n_fft, axis=1)[:, : (frames - 1) * hop + 1 : hop]


def _centered(window: np.ndarray, n_fft: int) -> np.ndarray:
    left = (n_fft - len(window)) // 2
    return np.pad(window, (left, n_fft - len(window) - left))


def _unframed(done: DataFrame, keys: Sequence[str], per_chunk: int, bins: int, axes: tuple[str, str], real: bool) -> DataFrame:
    """Kernel rows ``[frame, bin]`` back to cells with global frame numbers."""
    cells = _exploded(done, [*keys, "_chunk"], "_i", real)
    frame = F.col("_chunk") * F.lit(per_chunk) + F.floor(F.col("_i") / F.lit(bins))
    return cells.withColumns({axes[0]: F.pmod(F.col("_i"), F.lit(bins)), axes[1]: frame})


def stft(
    sig: Signal, axis: str = "time", n_fft: int = 256, hop: int | None = None, win_length: int | None = None,
    window: Sequence[float] | None = None, center: bool = True, pad_mode: str = "reflect", normalized: bool = False,
    onesided: bool | None = None, sizes: dict[str, int] | None = None, span: int = 8192,
) -> Signal:
    """Short-time Fourier transform; axes end in (freq, frame)."""
    sig.require(axis)
    if onesided and sig.is_complex:
        raise ValueError("onesided needs real cells")
    one = (not sig.is_complex) if onesided is None else onesided
    hop, win_length = hop or n_fft // 4, win_length or n_fft
    shape = periodic_window("hann", win_length) if window is None else np.asarray(window, dtype=float)
    shape = _centered(shape, n_fft)
    scale = 1.0 / math.sqrt(n_fft) if normalized else 1.0
    packed, per_chunk = _framed(sig, axis, n_fft, hop, pad_mode if center else None, sizes, span)
    bins = n_fft // 2 + 1 if one else n_fft

    def kernel(x, frames):
        view = _frame_view(x, frames, n_fft, hop) * shape
        return (np.fft.rfft(view.real, axis=2) if one else np.fft.fft(view, axis=2)) * scale

    done = packed.withColumn("_y", array_kernel(kernel, sig.parts, F.col("_frames")))
    kept = [a for a in sig.axes if a != axis]
    cells = _unframed(done, sig.keys(axis), per_chunk, bins, ("freq", "frame"), False)
    known = {**sig.sizes, **(sizes or {})}.get(axis)
    pad = n_fft // 2 * 2 if center else 0
    frames = None if known is None else max(0, (known + pad - n_fft) // hop + 1)
    return replace(sig.with_cells(cells, [*kept, "freq", "frame"], {"freq": bins, "frame": frames}), coords=None)


def acoustic_stft(sig: Signal, **args) -> Signal:
    return stft(sig, axis="sample", **args)


def dense_doppler(
    sig: Signal, sample_rate: int, window_size: int, window_step: int, nfft: int, max_doppler_hz: int,
    target_time_bins: int | None = None, sizes: dict[str, int] | None = None, span: int = 8192,
) -> Signal:
    """Doppler amplitude of mean-free CSI on (time_bin, freq_bin, subc, link).

    Zero-padded centred frames, a Gaussian window, the bins within
    +/-max_doppler rolled so that negative frequencies come first.
    """
    sig.require("time", "subc", "tx", "rx", kind="complex")
    means = with_statistics(sig, sig.keys("time"), F.avg("re").alias("_mr"), F.avg("im").alias("_mi"))
    free = sig.with_cells(means.withColumns({"re": F.col("re") - F.col("_mr"), "im": F.col("im") - F.col("_mi")}))
    packed, per_chunk = _framed(free, "time", nfft, window_step, "constant", sizes, span)
    weights = gaussian_window(window_size, float(window_size))
    shape = _centered(weights, nfft)
    freqs = np.fft.fftfreq(nfft, d=1.0 / sample_rate)
    picked = np.flatnonzero((freqs >= -max_doppler_hz) & (freqs <= max_doppler_hz))
    picked = np.roll(picked, max_doppler_hz)

    def kernel(x, frames):
        spectra = np.fft.fft(_frame_view(x, frames, nfft, window_step) * shape, axis=2)
        return np.abs(spectra[:, :, picked]) / max(weights.sum(), 1e-8)

    done = packed.withColumn("_y", array_kernel(kernel, sig.parts, F.col("_frames"), real=True))
    cells = _unframed(done, sig.keys("time"), per_chunk, len(picked), ("freq_bin", "time_bin"), True)
    known = {**sig.sizes, **(sizes or {})}
    if "tx" in known:
        linked = cells.withColumn("_len_tx", F.lit(known["tx"]))
    else:
        linked = cells.join(axis_lengths(sig, "tx"), on=KEY)
    linked = linked.withColumn("link", F.col("rx") * F.col("_len_tx") + F.col("tx"))
    links = known["tx"] * known["rx"] if {"tx", "rx"} <= set(known) else None
    frames = known["time"] // window_step + 1 if "time" in known and nfft % 2 == 0 else None
    out = sig.with_cells(
        linked, ["time_bin", "freq_bin", "subc", "link"],
        {"time_bin": frames, "freq_bin": len(picked), "link": links},
    )
    if target_time_bins is None:
        return out
    from cellwave.operators.axes import resize_axis

    return resize_axis(out, "time_bin", target_time_bins, crop="center")


def doppler_bins(sample_rate: int, nfft: int, max_doppler_hz: int) -> list[float]:
    """Frequencies of the ``freq_bin`` axis of :func:`dense_doppler`."""
    freqs = np.fft.fftfreq(nfft, d=1.0 / sample_rate)
    kept = freqs[(freqs >= -max_doppler_hz) & (freqs <= max_doppler_hz)]
    return [float(f) for f in np.roll(kept, max_doppler_hz)]


def _real_view(sig: Signal, value: str) -> Signal:
    if not sig.is_complex:
        return sig
    exprs = {"magnitude": F.hypot("re", "im"), "real": F.col("re"), "imag": F.col("im")}
    return sig.with_parts(value=exprs[value])


def _chunk_windows(sig: Signal, axis: str, chunk: int, before: int, after: int) -> DataFrame:
    """Real values per chunk with halo, plus where the chunk's own part lies."""
    rows = with_halo(sig.cells, axis, chunk, before, after)
    keys = [*sig.keys(axis), "_chunk"]
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("_rows"),
        F.count_if("_own").cast("int").alias("_owned"),
        F.min(F.when(F.col("_own"), F.col(axis))).alias("_start"),
    ).where("_owned > 0")
    lead = (F.col("_start") - F.element_at(f"_rows.{axis}", 1)).cast("int")
    return packed.select(*keys, F.col("_rows.value").alias("value"), lead.alias("_lead"), "_owned", "_start")


def autocorrelation(
    sig: Signal, axis: str = "time", max_lag: int | None = None, normalized: bool = True, value: str = "real",
    chunk: int = 65536, long_series: bool | None = None,
) -> Signal:
    """Autocorrelation at lags 0..max_lag, divided by lag 0 if normalised.

    Chunks add up the products of their own starts. Without ``max_lag`` every
    lag needs the whole series: one of up to ``chunk`` cells is packed, a longer
    one goes through the power spectrum of the zero-padded series. Declared
    sizes or ``long_series`` decide for all series at once; else each sample's
    own length does. Series declared as short (``SHORT_LAGS`` cells) never leave the JVM.
    """
    view = _real_view(sig, value)
    if max_lag is not None:
        return _scaled_lags(view, axis, _packed_lags(view, axis, chunk, max_lag), normalized)
    known = view.sizes.get(axis)
    if long_series is None and known is None:
        cells = with_lengths(view, axis)
        near, far = (view.with_cells(cells.where(c)) for c in (F.col(f"_len_{axis}") <= chunk, F.col(f"_len_{axis}") > chunk))
        sums = _packed_lags(near, axis, 1 << 40, None).unionByName(_spectral_lags(far, axis))
    elif long_series or (long_series is None and known > chunk):
        sums = _spectral_lags(view, axis)
    elif known is not None and known <= SHORT_LAGS:
        sums = _direct_lags(view, axis)
    else:
        sums = _packed_lags(view, axis, 1 << 40, None)
    return _scaled_lags(view, axis, sums, normalized)


def _packed_lags(view: Signal, axis: str, size: int, max_lag: int | None) -> DataFrame:
    """Sums of products at each lag, chunk by chunk."""
    packed = _chunk_windows(view, axis, size, 0, max_lag or 0)

    def kernel(x, owned):
        lags = x.shape[1] if max_lag is None else min(max_lag + 1, x.shape[1])
        n = 1 << int(np.ceil(np.log2(max(2 * x.shape[1], 2))))
        own = np.fft.rfft(x[:, :owned], n=n, axis=1)
        return np.fft.irfft(np.conj(own) * np.fft.rfft(x, n=n, axis=1), n=n, axis=1)[:, :lags]

    done = packed.withColumn("_y", array_kernel(kernel, ["value"], F.col("_owned"), real=True))
    return _exploded(done, view.keys(axis), "lag", True).groupBy(*view.keys(axis), "lag").agg(F.sum("value").alias("value"))


def _direct_lags(view: Signal, axis: str) -> DataFrame:
    """All lags of short series, product by product."""
    rows = view.cells.groupBy(*view.keys(axis)).agg(F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("_rows"))
    v, n = F.col("_v"), F.size("_v")
    zero = F.lit(0.0).cast("double")

    def products(lag: Column) -> Column:
        return F.zip_with(F.slice(v, F.lit(1), n - lag), F.slice(v, lag + 1, n - lag), lambda a, b: a * b)

    sums = F.transform(F.sequence(F.lit(0), n - 1), lambda lag: F.aggregate(products(lag), zero, lambda total, x: total + x))
    done = rows.select(*view.keys(axis), F.col("_rows.value").cast("array<double>").alias("_v"))
    return _exploded(done.withColumn("_y", sums), view.keys(axis), "lag", True)


def _spectral_lags(sig: Signal, axis: str) -> DataFrame:
    """All lags of real series from their power spectrum at twice the length."""
    rows = with_lengths(sig, axis)
    size = F.col(f"_len_{axis}")
    both = F.array(
        F.struct(F.col(axis).cast("bigint").alias("i"), F.col("value").alias("v")),
        F.struct((F.col(axis) + size).cast("bigint").alias("i"), F.lit(0.0).alias("v")),
    )
    padded = rows.withColumn("_p", F.explode(both)).withColumns({axis: F.col("_p.i"), "value": F.col("_p.v")})
    spectrum = fft_long(sig.with_cells(padded, sizes={axis: None}), axis, "backward")
    power = spectrum.with_parts(re=F.col("re") * F.col("re") + F.col("im") * F.col("im"), im=F.lit(0.0))
    back = fft_long(power, "freq", "backward", new_axis="lag", inverse=True)
    halved = with_lengths(back, "lag").where(F.col("lag") < F.col("_len_lag") / 2)
    return halved.select(*sig.keys(axis), "lag", F.col("re").alias("value"))


def _scaled_lags(view: Signal, axis: str, sums: DataFrame, normalized: bool) -> Signal:
    sig, kept = view, [a for a in view.axes if a != axis]
    out = view.with_cells(sums, [*kept, "lag"])
    if not normalized:
        return out
    base = sums.where("lag = 0").select(*sig.keys(axis), F.greatest("value", F.lit(1e-8)).alias("_zero"))
    scaled = sums.join(base, on=sig.keys(axis)).withColumn("value", F.col("value") / F.col("_zero"))
    return out.with_cells(scaled)


def wavelet_kernels(
    sample_rate: float, num_frequencies: int, min_hz: float, max_hz: float | None, cycles: float
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """``(frequency, cosine, sine)`` L1-normalised kernels on a geometric grid."""
    top = sample_rate / 2.0 if max_hz is None else min(max_hz, sample_rate / 2.0)
    if min_hz <= 0 or top <= min_hz:
        raise ValueError("need 0 < min frequency < max frequency")
    kernels = []
    for f in np.geomspace(min_hz, top, num_frequencies):
        sigma = cycles / (2.0 * np.pi * f)
        half = max(1, round(4.0 * sigma * sample_rate))
        t = np.arange(-half, half + 1) / sample_rate
        envelope = np.exp(-0.5 * (t / sigma) ** 2)
        waves = [np.cos(2 * np.pi * f * t) * envelope, np.sin(2 * np.pi * f * t) * envelope]
        kernels.append((float(f), *(w / max(np.abs(w).sum(), 1e-8) for w in waves)))
    return kernels


def wavelet_scalogram(
    sig: Signal, sample_rate: float, axis: str = "time", num_frequencies: int = 32, min_hz: float = 1.0,
    max_hz: float | None = None, cycles: float = 6.0, value: str = "real", chunk: int = 65536,
) -> Signal:
    """Morlet response modulus; axes end in (pseudo_freq, frame)."""
    sig.require(axis)
    kernels = wavelet_kernels(sample_rate, num_frequencies, min_hz, max_hz, cycles)
    reach = max(len(c) // 2 for _, c, _ in kernels)
    packed = _chunk_windows(_real_view(sig, value), axis, chunk, reach, reach)

    def kernel(x, lead, owned):
        n = x.shape[1] + 2 * reach
        spectrum = np.fft.rfft(x, n=n, axis=1)
        responses = []
        for _, cosine, sine in kernels:
            half = len(cosine) // 2
            cut = slice(lead + half, lead + half + owned)
            parts = [np.fft.irfft(spectrum * np.fft.rfft(k, n=n), n=n, axis=1)[:, cut] for k in (cosine, sine)]
            responses.append(np.hypot(*parts))
        return np.stack(responses, axis=1)

    done = packed.withColumn("_y", array_kernel(kernel, ["value"], F.col("_lead"), F.col("_owned"), real=True))
    cells = _exploded(done, [*sig.keys(axis), "_owned", "_start"], "_i", True).withColumns({
        "pseudo_freq": F.floor(F.col("_i") / F.col("_owned")),
        "frame": F.col("_start") + F.pmod(F.col("_i"), F.col("_owned")),
    })
    kept = [a for a in sig.axes if a != axis]
    return replace(sig.with_cells(cells, [*kept, "pseudo_freq", "frame"]), coords=None)


def pack_block(sig: Signal, axes: Sequence[str]) -> DataFrame:
    """One row per remaining key: row-major array over several bounded axes, plus their sizes."""
    keys = [KEY, *(a for a in sig.axes if a not in axes)]
    rows = F.array_sort(F.collect_list(F.struct(*axes, *sig.parts)))
    packed = sig.cells.groupBy(*keys).agg(
        rows.alias("_rows"), *((F.max(a) + 1).cast("int").alias(f"_n_{a}") for a in axes)
    )
    return packed.select(*keys, *(f"_n_{a}" for a in axes), *(F.col(f"_rows.{p}").alias(p) for p in sig.parts))


def map_block(
    sig: Signal, axes: Sequence[str], kernel: Callable, out_axes: dict[str, int | Column], real: bool = False,
    flags: dict[str, Column] | None = None,
) -> Signal:
    """Run a kernel ``fn(block[rows, *axes], *flags)`` on several axes at once.

    ``out_axes`` names the result axes and their sizes, row-major.
    """
    sig.require(*axes)
    keys = [KEY, *(a for a in sig.axes if a not in axes)]
    packed = pack_block(sig, axes)
    flags = flags or {}
    if flags:
        packed = packed.join(sig.samples.select(KEY, *(c.alias(n) for n, c in flags.items())), on=KEY)

    def shaped(x, *rest):
        sizes = rest[: len(axes)]
        return kernel(x.reshape(x.shape[0], *sizes), *rest[len(axes) :])

    sizes = [F.col(f"_n_{a}") for a in axes]
    packed = packed.withColumn("_y", array_kernel(shaped, sig.parts, *sizes, *(F.col(n) for n in flags), real=real))
    cells = _exploded(packed, [*keys, *(f"_n_{a}" for a in axes)], "_i", real)
    rest, columns = F.col("_i"), {}
    for name, size in reversed(list(out_axes.items())):
        size = F.lit(size) if isinstance(size, int) else size
        columns[name] = F.pmod(rest, size)
        rest = F.floor(rest / size)
    cells = cells.select(
        *keys, *(c.cast("bigint").alias(n) for n, c in columns.items()),
        *(["value"] if real else ["re", "im"]),
    )
    kept = [a for a in sig.axes if a not in axes]
    known = {a: n if isinstance(n, int) else None for a, n in out_axes.items()}
    return replace(sig.with_cells(cells, [*kept, *out_axes], known), coords=None)


def beamform(
    sig: Signal, sample_rate: float, angles_deg: Sequence[float], mic_spacing: float = 0.01,
    mic_positions: Sequence[float] | None = None, speed: float = SPEED_OF_SOUND,
) -> Signal:
    """Delay-and-sum over microphones in the frequency domain; mic becomes angle."""
    sig.require("sample", "mic", kind="real")
    angles = np.deg2rad(np.asarray(angles_deg, dtype=float))

    def kernel(x):
        n, mics = x.shape[1:]
        places = np.arange(mics) * mic_spacing if mic_positions is None else np.asarray(mic_positions, dtype=float)
        delays = np.outer(np.sin(angles), places) / speed
        freqs = np.fft.rfftfreq(n, d=1.0 / sample_rate)
        steering = np.exp(-2j * np.pi * delays[:, :, None] * freqs)
        steered = np.einsum("amf,bfm->bfa", steering, np.fft.rfft(x, axis=1))
        return np.fft.irfft(steered, n=n, axis=1)

    return map_block(
        sig, ["sample", "mic"], kernel, {"sample": F.col("_n_sample"), "angle": len(angles)}, real=True
    )


def fmcw_demod(
    sig: Signal, sample_rate: float, center_freq: float, bandwidth: float, n_fft: int | None = None,
    window: str = "hann", axis: str = "sample", method: str = "auto",
) -> Signal:
    """Mix with the reference chirp, window, FFT: sample becomes range."""
    if min(sample_rate, center_freq, bandwidth) <= 0:
        raise ValueError("sample_rate, center_freq and bandwidth must be positive")

    def kernel(x):
        n = x.shape[1]
        t = np.arange(n) / sample_rate
        slope = bandwidth / (n / sample_rate)
        chirp = np.exp(2j * np.pi * (center_freq * t + 0.5 * slope * t**2))
        shape = periodic_window(window if window in ("hann", "hamming") else None, n)
        return np.fft.fft(x * np.conj(chirp) * shape, n=n_fft or n, axis=1)

    return map_linear(sig, axis, kernel, "range", method)


def _largest_low_divisor(n: Column) -> Column:
    """The largest divisor of n up to its square root."""
    low = F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n)))
    return F.array_max(F.filter(low, lambda d: n % d == 0))


def _turned(angle: Column) -> list[Column]:
    """(re, im) multiplied by exp(i * angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return [(F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im")]


def _four_step(cells: DataFrame, keys: list[str], axis: str, sign: int) -> DataFrame:
    """Unscaled DFT of ``(keys, _n, _n1, axis, re, im)`` in groups of _n1 and _n/_n1 cells."""
    names = [*keys, "_n", "_n1"]
    n2 = (F.col("_n") / F.col("_n1")).cast("bigint")

    def transform(x):
        return np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1) * x.shape[1]

    def columns(df: DataFrame, group: str, index: str, out: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(index, "re", "im")))
        packed = df.groupBy(*names, group).agg(rows.alias("_rows")).select(
            *names, group, F.col("_rows.re").alias("re"), F.col("_rows.im").alias("im")
        )
        done = packed.withColumn("_y", array_kernel(transform, ["re", "im"]))
        return _exploded(done, [*names, group], out, False)

    split = cells.select(
        *names, F.pmod(F.col(axis), n2).alias("_j2"), F.floor(F.col(axis) / n2).alias("_j1"), "re", "im"
    )
    inner = columns(split, "_j2", "_j1", "_k1")
    twisted = inner.select(*names, "_j2", "_k1", *_turned(sign * 2.0 * math.pi * F.col("_j2") * F.col("_k1") / F.col("_n")))
    outer = columns(twisted, "_k1", "_j2", "_k2")
    return outer.select(*names, (F.col("_k1") + F.col("_n1") * F.col("_k2")).alias(axis), "re", "im")


def _chirp_angle(index: Column) -> Column:
    """pi * index^2 / n with the square reduced first, which keeps it exact."""
    return math.pi * ((index * index) % (2 * F.col("_n"))) / F.col("_n")


def _chirp_transform(
    cells: DataFrame, lengths: DataFrame, keys: list[str], axis: str, sign: int
) -> DataFrame:
    """DFT of any length as a convolution with a chirp, on a power-of-two grid."""
    i, n = F.col(axis), F.col("_n")
    grid = F.pow(F.lit(2.0), F.ceil(F.log2(2 * n - 1))).cast("bigint")
    half = F.pow(F.lit(2.0), F.floor(F.ceil(F.log2(2 * n - 1)) / 2)).cast("bigint")
    lengths = lengths.select("_n").distinct().withColumns({"_m": grid, "_m1": half})
    sized = cells.withColumns({"_m": grid, "_m1": half})

    def on_grid(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*names, F.col("_n").alias("_len"), F.col("_m").alias("_n"), F.col("_m1").alias("_n1"), axis, "re", "im")

    names = [*keys, "_n", "_m", "_m1"]
    mixed = sized.select(*names, axis, *_turned(sign * _chirp_angle(i)))
    # zeros up to the grid size, spread over the cells of the series
    step = F.floor((F.col("_m") - n) / n) + 1
    zeros = F.sequence(n + i * step, F.least(n + (i + 1) * step, F.col("_m")) - 1)
    start = n + i * step
    pads = sized.where(start < F.col("_m")).select(
        *names, F.explode(zeros).alias(axis), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")
    )
    spectrum = _four_step(on_grid(mixed.unionByName(pads), keys), [*keys, "_len"], axis, -1)
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias(axis)
    near = F.least(i, F.col("_m") - i)
    angle = -sign * _chirp_angle(near)
    chirp = lengths.select("_n", "_m", "_m1", places).select(
        "_n", "_m", "_m1", axis,
        F.when(near < n, F.cos(angle)).otherwise(0.0).alias("re"), F.when(near < n, F.sin(angle)).otherwise(0.0).alias("im"),
    )
    response = _four_step(on_grid(chirp, []), ["_len"], axis, -1).select(
        "_len", axis, F.col("re").alias("_cr"), F.col("im").alias("_ci")
    )
    joined = spectrum.join(response, on=["_len", axis])
    product = joined.select(
        *keys, "_len", "_n", "_n1", axis,
        (F.col("re") * F.col("_cr") - F.col("im") * F.col("_ci")).alias("re"),
        (F.col("re") * F.col("_ci") + F.col("im") * F.col("_cr")).alias("im"),
    )
    back = _four_step(product, [*keys, "_len"], axis, 1).where(i < F.col("_len"))
    scaled = back.select(
        *keys, F.col("_len").alias("_n"), axis,
        (F.col("re") / F.col("_n")).alias("re"), (F.col("im") / F.col("_n")).alias("im"),
    )
    return scaled.select(*keys, "_n", axis, *_turned(sign * _chirp_angle(i)))


def fft_long(
    sig: Signal, axis: str = "time", norm: str = "ortho", new_axis: str = "freq", inverse: bool = False,
    max_group: int = 1 << 16, sizes: dict[str, int] | None = None,
) -> Signal:
    """DFT along an axis as long as a capture.

    The four-step form needs two exchanges whose groups hold about sqrt(n)
    cells; lengths without a fitting divisor go through a chirp convolution.
    """
    sig.require(axis)
    sign = 1 if inverse else -1
    keys = sig.keys(axis)
    parts = ["re", "im"] if sig.is_complex else [F.col("value").alias("re"), F.lit(0.0).alias("im")]
    known = {**sig.sizes, **(sizes or {})}
    if axis in known:
        lengths = sig.cells.select(KEY).distinct().withColumn("_n", F.lit(known[axis]).cast("bigint"))
    else:
        lengths = axis_lengths(sig, axis).select(KEY, F.col(f"_len_{axis}").alias("_n"))
    lengths = lengths.withColumn("_n1", _largest_low_divisor(F.col("_n")))
    fits = F.col("_n") / F.col("_n1") <= max_group
    cells = sig.cells.join(lengths, on=KEY).select(*keys, F.col(axis).cast("bigint").alias(axis), "_n", "_n1", *parts)
    done = _four_step(cells.where(fits), keys, axis, sign).drop("_n1").unionByName(
        _chirp_transform(cells.where(~fits).drop("_n1"), lengths.where(~fits), keys, axis, sign)
    )
    root = F.sqrt(F.col("_n").cast("double"))
    forward = {"ortho": 1.0 / root, "forward": 1.0 / F.col("_n"), "backward": F.lit(1.0)}
    backward = {"ortho": 1.0 / root, "forward": F.lit(1.0), "backward": 1.0 / F.col("_n")}
    scale = (backward if inverse else forward)[norm]
    names = [new_axis if a == axis else a for a in sig.axes]
    out = done.select(
        *keys, F.col(axis).alias(new_axis), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im")
    )
    return replace(sig.with_cells(out, names, {new_axis: sig.sizes.get(axis)}), coords=None)
