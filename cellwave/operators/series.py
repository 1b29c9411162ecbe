"""Operators along one axis of CSI, UWB, BLE and radar signals.

Hardware axes (subcarrier, tap, antenna) are bounded, so a window per series
is safe. Time-like axes are cut into chunks with a halo.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwave.functions.columns import SPEED_OF_LIGHT, floor_mod, null_safe
from cellwave.functions.kernels import (
    array_kernel,
    butterworth,
    decay_length,
    hampel,
    iir_states,
    state_step,
    steady_state,
    zero_phase,
)
from cellwave.model import KEY, Signal
from cellwave.operators.axes import select_index, with_lengths
from cellwave.operators.normalize import subcarrier_l1
from cellwave.operators.ordinal import with_halo, written
from cellwave.operators.packed import with_statistics

CHUNK = 65536
LONG_AXES = ("time", "frame", "sample", "point", "packet")
MAD_SCALE = 1.4826


def axis_chunk(axis: str, chunk: int | None) -> int:
    """Chunk length of an axis; a bounded axis fits one chunk."""
    return chunk or (CHUNK if axis in LONG_AXES else 1 << 40)


def hampel_filter(
    sig: Signal, axis: str = "time", window: int = 11, threshold: float = 3.0, chunk: int | None = None
) -> Signal:
    """Replace outliers by the window's upper-median cell.

    The limit uses the lower median of the modulus and the lower-median MAD;
    windows shrink at the ends of a series. Chunks of a series are packed with
    the halo that their windows need.
    """
    sig.require(axis)
    if window % 2 == 0:
        raise ValueError(f"window must be odd, got {window}")
    half = window // 2
    rows = with_halo(sig.cells, axis, axis_chunk(axis, chunk), half, half)
    packed = rows.groupBy(*sig.keys(axis), "_chunk").agg(F.array_sort(F.collect_list(F.struct(axis, "_own", *sig.parts))).alias("_rows"))
    packed = packed.select(*sig.keys(axis), "_rows", *(F.col(f"_rows.{p}").alias(p) for p in sig.parts))
    kernel = array_kernel(lambda x: hampel(x, half, threshold * MAD_SCALE), sig.parts, real=not sig.is_complex)
    done = packed.withColumn("_y", kernel)
    clean = [F.col("_y.re").alias("re"), F.col("_y.im").alias("im")] if sig.is_complex else [F.col("_y").alias("value")]
    zipped = F.arrays_zip(F.col(f"_rows.{axis}").alias(axis), F.col("_rows._own").alias("own"), *clean)
    out = done.select(*sig.keys(axis), F.explode(F.filter(zipped, lambda c: c["own"])).alias("_c"))
    return sig.with_cells(out.select(*sig.keys(axis), *(F.col(f"_c.{c}").alias(c) for c in (axis, *sig.parts))))


def _wrapped_step(step: Column, limit: float) -> Column:
    """A phase step folded into [-limit, limit); a positive jump of one limit stays positive."""
    folded = floor_mod(step + limit, 2.0 * limit) - limit
    return F.when((folded == -limit) & (step > 0), F.lit(limit)).otherwise(folded)


def phase_unwrap(
    sig: Signal, axis: str = "subc", discont: float | None = None, chunk: int | None = None
) -> Signal:
    """Continuous phase along an axis; real cells are taken as phases."""
    sig.require(axis)
    limit = math.pi if discont is None else discont
    phase = F.atan2("im", "re") if sig.is_complex else F.col("value")
    cells = sig.cells.select(*sig.keys(), phase.alias("_phase"))
    keys = [*sig.keys(axis), "_chunk"]
    rows = with_halo(cells, axis, axis_chunk(axis, chunk), 1, 0)
    order = Window.partitionBy(*keys).orderBy(axis)
    step = F.col("_phase") - F.lag("_phase").over(order)
    rows = rows.withColumn("_step", step)
    turn = F.coalesce(_wrapped_step(F.col("_step"), limit) - F.col("_step"), F.lit(0.0))
    rows = rows.withColumn("_turn", turn)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.sum("_turn").over(upto)).where("_own")
    if axis_chunk(axis, chunk) >= 1 << 40:
        out = rows.withColumn("value", F.col("_phase") + F.col("_run"))
        return sig.with_cells(out)
    # turns of the chunks before, from one small row per chunk
    totals = rows.groupBy(*keys).agg(F.sum("_turn").alias("_sum"))
    before = (
        Window.partitionBy(*sig.keys(axis)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_start"))
    out = rows.join(starts, on=keys)
    return sig.with_cells(out.withColumn("value", F.col("_phase") + F.col("_start") + F.col("_run")))


def phase_calibration(sig: Signal, axis: str = "subc") -> Signal:
    """Remove the least-squares line of the unwrapped phase over subcarriers."""
    sig.require(axis, kind="complex")
    w = Window.partitionBy(*sig.keys(axis))
    order = w.orderBy(axis)
    rows = sig.cells.withColumn("_phase", F.atan2("im", "re"))
    rows = rows.withColumn("_step", F.col("_phase") - F.lag("_phase").over(order))
    turn = F.coalesce(_wrapped_step(F.col("_step"), math.pi) - F.col("_step"), F.lit(0.0))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turn", turn).withColumn("_un", F.col("_phase") + F.sum("_turn").over(upto))
    slope, offset = F.regr_slope("_un", axis).over(w), F.regr_intercept("_un", axis).over(w)
    rows = rows.withColumn("_line", slope * F.col(axis) + offset)
    c, s = F.cos("_line"), F.sin("_line")
    return sig.with_cells(rows.select(
        *sig.keys(), (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im")
    ))


def csi_ratio(sig: Signal, rx_num: int = 1, rx_den: int = 0, axis: str = "rx") -> Signal:
    """Quotient of two receive streams; the rx axis drops."""
    sig.require(axis, kind="complex")

    def of(rx: int, part: str) -> Column:
        return F.max(F.when(F.col(axis) == rx, F.col(part)))

    pair = sig.cells.groupBy(*sig.keys(axis)).agg(
        of(rx_num, "re").alias("a"), of(rx_num, "im").alias("b"),
        of(rx_den, "re").alias("c"), of(rx_den, "im").alias("d"),
    )
    tiny = F.hypot("c", "d") < 1e-10
    pair = pair.withColumns({"c": F.when(tiny, 1e-10).otherwise(F.col("c")), "d": F.when(tiny, 0.0).otherwise(F.col("d"))})
    power = F.col("c") * F.col("c") + F.col("d") * F.col("d")
    re = (F.col("a") * F.col("c") + F.col("b") * F.col("d")) / power
    im = (F.col("b") * F.col("c") - F.col("a") * F.col("d")) / power
    kept = [a for a in sig.axes if a != axis]
    return sig.with_cells(pair.select(*sig.keys(axis), re.alias("re"), im.alias("im")), kept)


def _times_conjugate(a_re, a_im, b_re, b_im) -> tuple[Column, Column]:
    return a_re * b_re + a_im * b_im, a_im * b_re - a_re * b_im


def adjacent_rx_conjugate(sig: Signal, axis: str = "rx") -> Signal:
    """Each stream times the conjugate of the next one.

    One stream passes, two give one product, three or more wrap around.
    """
    sig.require(axis, kind="complex")
    w = Window.partitionBy(*sig.keys(axis))
    order = w.orderBy(axis)
    following = {p: F.coalesce(F.lead(p).over(order), F.first(p).over(order)) for p in ("re", "im")}
    rows = sig.cells.withColumns(
        {"_n": F.count("*").over(w), "_re": following["re"], "_im": following["im"]}
    ).where((F.col("_n") != 2) | (F.col(axis) == 0))
    re, im = _times_conjugate(F.col("re"), F.col("im"), F.col("_re"), F.col("_im"))
    alone = F.col("_n") == 1
    out = rows.select(
        *sig.keys(),
        F.when(alone, F.col("re")).otherwise(re).alias("re"),
        F.when(alone, F.col("im")).otherwise(im).alias("im"),
    )
    known = sig.sizes.get(axis)
    return sig.with_cells(out, sizes={axis: 1 if known == 2 else known})


def reference_rx_conjugate(
    sig: Signal, ref_rx: int = 0, rx_axis: str = "rx", axis: str = "subc", new_axis: str = "conj_subc",
    allow_passthrough: bool = False,
) -> Signal:
    """Every stream times the conjugate of one reference stream; renames an axis."""
    sig.require(axis)
    names = tuple(new_axis if a == axis else a for a in sig.axes)
    if rx_axis not in sig.axes:
        if not allow_passthrough:
            raise ValueError(f"axis {rx_axis!r} not found; the signal has {sig.axes}")
        return sig.with_cells(sig.cells.withColumnRenamed(axis, new_axis), names, {new_axis: sig.sizes.get(axis)})
    sig.require(kind="complex")
    w = Window.partitionBy(*sig.keys(rx_axis))
    ref = {p: F.max(F.when(F.col(rx_axis) == ref_rx, F.col(p))).over(w) for p in ("re", "im")}
    rows = sig.cells.withColumns({"_re": ref["re"], "_im": ref["im"]})
    re, im = _times_conjugate(F.col("re"), F.col("im"), F.col("_re"), F.col("_im"))
    out = rows.select(*sig.keys(), re.alias("re"), im.alias("im")).withColumnRenamed(axis, new_axis)
    return sig.with_cells(out, names, {new_axis: sig.sizes.get(axis)})


def temporal_filter(
    sig: Signal,
    sample_rate: float,
    lowpass_hz: float,
    highpass_hz: float,
    lowpass_order: int,
    highpass_order: int,
    axis: str = "time",
    chunk: int | None = None,
    sizes: dict[str, int] | None = None,
) -> Signal:
    """Zero-phase Butterworth low-pass, then high-pass, along time.

    A long series is filtered in chunks. Where a chunk is longer than both
    filters take to forget its border to 1e-18, chunks overlap by that halo;
    filters that remember longer carry their state from chunk to chunk
    (``scanned_filter``). Both agree with a whole series to rounding; odd
    extension applies at real ends only.
    """
    sig.require(axis, kind="complex")
    upper = min(float(lowpass_hz), sample_rate / 2.0 - 1.0)
    if upper <= 0:
        raise ValueError("low-pass cutoff must stay below Nyquist after clipping")
    stages = [
        butterworth(lowpass_order, upper, sample_rate, "low"),
        butterworth(highpass_order, float(highpass_hz), sample_rate, "high"),
    ]
    halo = sum(decay_length(a) + 3 * len(a) for _, a in stages)
    length = axis_chunk(axis, chunk)
    cells = with_lengths(sig, axis, sizes=sizes)
    if halo > length:
        return scanned_filter(sig, cells, stages, axis, length)
    rows = with_halo(cells, axis, length, halo, halo)
    keys = [*sig.keys(axis), "_chunk"]
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(axis, "_own", "re", "im"))).alias("_rows"),
        F.max(f"_len_{axis}").alias("_n"),
    )
    packed = packed.select(
        *keys, F.col(f"_rows.{axis}").alias("_t"), F.col("_rows._own").alias("_owns"),
        F.col("_rows.re").alias("re"), F.col("_rows.im").alias("im"),
        (F.element_at(f"_rows.{axis}", 1) == 0).alias("_head"),
        (F.element_at(f"_rows.{axis}", -1) == F.col("_n") - 1).alias("_tail"),
    )

    def kernel(block, head, tail):
        for b, a in stages:
            block = zero_phase(block, b, a, head, tail)
        return block

    done = packed.withColumn("_y", array_kernel(kernel, ["re", "im"], F.col("_head"), F.col("_tail")))
    zipped = F.arrays_zip(
        F.col("_t").alias(axis), F.col("_owns").alias("own"), F.col("_y.re").alias("re"), F.col("_y.im").alias("im")
    )
    out = done.select(*sig.keys(axis), F.explode(F.filter(zipped, lambda c: c["own"])).alias("_c"))
    return sig.with_cells(out.select(*sig.keys(axis), f"_c.{axis}", "_c.re", "_c.im"))


def _series_packs(sig: Signal, cells: DataFrame, axis: str, length: int) -> DataFrame:
    """``(keys, _chunk, _last, _pack)``: samples of each chunk as complex numbers; the last chunk takes the rest."""
    last = F.greatest(F.floor(F.col(f"_len_{axis}") / F.lit(length)), F.lit(1)) - 1
    at = F.least(F.floor(F.col(axis) / F.lit(length)), last)
    rows = cells.withColumns({"_chunk": at, "_last": last}).groupBy(*sig.keys(axis), "_chunk").agg(
        F.max("_last").alias("_last"), F.array_sort(F.collect_list(F.struct(axis, "re", "im"))).alias("_rows")
    )
    return rows.select(*sig.keys(axis), "_chunk", "_last", F.col("_rows.re").alias("re"), F.col("_rows.im").alias("im"))


def _map_chunks(rows: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn(row) -> dict`` for every chunk; a task holds one chunk at a time."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([fn(row)], to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def _scan(keys: list[str], step: np.ndarray, settled: np.ndarray, backward: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that each chunk of one series begins with."""
        pdf = pdf.sort_values("_chunk", ascending=not backward)
        first = pdf.iloc[0]
        state, out, powers = settled * (first["x_re"] + 1j * first["x_im"]), [], {}
        for n, re, im in zip(pdf["n"], pdf["end_re"], pdf["end_im"]):
            out.append(state)
            if n not in powers:
                powers[n] = np.linalg.matrix_power(step, n)
            state = powers[n] @ state + np.array(re) + 1j * np.array(im)
        return pdf[[*keys, "_chunk"]].assign(begin_re=[s.real for s in out], begin_im=[s.imag for s in out])

    return run


def scanned_filter(sig: Signal, cells: DataFrame, stages: list[tuple[np.ndarray, np.ndarray]], axis: str, length: int) -> Signal:
    """Zero-phase filters of series in chunks that carry the filter's state, exact for any memory.

    A chunk's last state is its response to its own samples from rest plus the matrix power of its length times the
    state before. Such steps compose, so one row a chunk gives every chunk the state it begins with: forward, then
    backward over what the forward pass made. A series is read once a pass; no group is larger than two chunks' cells
    or a row a chunk.
    """
    if length <= 3 * max(len(a) for _, a in stages):
        raise ValueError(f"chunks of {length} are not longer than the padding")
    keys = sig.keys(axis)
    rows = _series_packs(sig, cells, axis, length)
    short = F.size("re") <= 3 * max(len(a) for _, a in stages)
    rows = written(rows.withColumn("re", F.when(short, F.raise_error(F.lit("a series is not longer than the padding"))).otherwise(F.col("re"))), "filter-packs")
    numbers = T.ArrayType(T.DoubleType())
    kept = [rows.schema[c] for c in (*keys, "_chunk", "_last")]
    packs = T.StructType([*kept, T.StructField("re", numbers), T.StructField("im", numbers)])
    ends = T.StructType([*kept, *(T.StructField(c, numbers) for c in ("end_re", "end_im")),
                         T.StructField("n", T.LongType()), T.StructField("x_re", T.DoubleType()), T.StructField("x_im", T.DoubleType())])
    begins = T.StructType([*(rows.schema[c] for c in (*keys, "_chunk")), *(T.StructField(c, numbers) for c in ("begin_re", "begin_im"))])
    for b, a in stages:
        edge, settled, step = 3 * len(a), steady_state(b, a), state_step(a)

        def whole(row: dict, x: np.ndarray, edge: int = edge) -> np.ndarray:
            """A chunk with the odd extension at the real ends."""
            left = 2 * x[:1] - x[edge:0:-1] if row["_chunk"] == 0 else x[:0]
            right = 2 * x[-1:] - x[-2 : -edge - 2 : -1] if row["_chunk"] == row["_last"] else x[:0]
            return np.concatenate([left, x, right])

        def sample(row: dict) -> np.ndarray:
            return np.array(row["re"]) + 1j * np.array(row["im"])

        def same(row: dict) -> dict:
            return {c: row[c] for c in (*keys, "_chunk", "_last")}

        def turned(x: np.ndarray, backward: bool) -> np.ndarray:
            return x[::-1] if backward else x

        for backward in (False, True):

            def end(row: dict, b=b, a=a, backward=backward, whole=whole) -> dict:
                x = turned(sample(row) if backward else whole(row, sample(row)), backward)
                _, state = iir_states(x[None], b, a, np.zeros((1, len(a) - 1), complex))
                return same(row) | {"end_re": state[0].real, "end_im": state[0].imag, "n": len(x), "x_re": x[0].real, "x_im": x[0].imag}

            def through(row: dict, b=b, a=a, backward=backward, whole=whole, edge=edge) -> dict:
                x = sample(row) if backward else whole(row, sample(row))
                state = (np.array(row["begin_re"]) + 1j * np.array(row["begin_im"]))[None]
                y = turned(iir_states(turned(x, backward)[None], b, a, state)[0][0], backward)
                if backward:  # what the extension made goes
                    y = y[edge if row["_chunk"] == 0 else 0 : len(y) - (edge if row["_chunk"] == row["_last"] else 0)]
                return same(row) | {"re": y.real, "im": y.imag}

            starts = _map_chunks(rows, end, ends).groupBy(*keys).applyInPandas(_scan(keys, step, settled, backward), begins)
            rows = written(_map_chunks(null_safe(rows, starts, [*keys, "_chunk"]), through, packs), "filter-packs")
    at = F.posexplode(F.arrays_zip("re", "im")).alias("_i", "_c")
    out = rows.select(*keys, "_chunk", at)
    return sig.with_cells(out.select(*keys, (F.col("_chunk") * length + F.col("_i")).alias(axis), "_c.re", "_c.im"))


def wifi_preprocess(sig: Signal, skip_reader_ids: Sequence[str] = (), **filter_args) -> Signal:
    """Subcarrier L1, adjacent-rx conjugate, temporal filter."""
    return temporal_filter(adjacent_rx_conjugate(subcarrier_l1(sig, skip_reader_ids=skip_reader_ids)), **filter_args)


def interpolation_weights(count: int, repair: Sequence[int], method: str) -> list[tuple[int, int, float]]:
    """``(target, source, weight)`` rows that rebuild repaired positions."""
    repair = sorted({r for r in repair if 0 <= r < count})
    known = np.array([i for i in range(count) if i not in set(repair)], dtype=float)
    if repair and not len(known):
        raise ValueError("no known position is left to interpolate from")
    rows = []
    for target in repair:
        if len(known) == 1:
            picks, weights = [0], [1.0]
        elif method == "linear" or len(known) < 4:
            right = int(np.clip(np.searchsorted(known, target, side="right"), 1, len(known) - 1))
            share = (target - known[right - 1]) / (known[right] - known[right - 1])
            picks, weights = [right - 1, right], [1.0 - share, share]
        else:
            center = int(np.clip(np.searchsorted(known, target), 1, len(known) - 2))
            start = int(np.clip(center - 2, 0, len(known) - 4))
            picks = list(range(start, start + 4))
            xs = known[picks]
            weights = [
                float(np.prod([(target - xs[o]) / (xs[i] - xs[o]) for o in range(4) if o != i]))
                for i in range(4)
            ]
        rows += [(target, int(known[p]), float(w)) for p, w in zip(picks, weights)]
    return rows


def pilot_interpolate(
    sig: Signal, repair_indices: Sequence[int], count: int, axis: str = "subc", method: str = "linear"
) -> Signal:
    """Rebuild pilot/null subcarriers from their known neighbours, in place.

    Complex cells interpolate modulus and unwrapped phase. The weights depend
    only on positions, so they are one literal map and the work is one sum.
    """
    sig.require(axis)
    if method not in ("linear", "cubic"):
        raise ValueError(f"unknown method {method!r}")
    weights = interpolation_weights(count, repair_indices, method)
    if not weights:
        return sig
    by_source: dict[int, list[tuple[int, float]]] = {}
    for target, source, weight in weights:
        by_source.setdefault(source, []).append((target, weight))
    pairs = []
    for source, uses in by_source.items():
        entry = F.array(*(F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(w).alias("w")) for t, w in uses))
        pairs += [F.lit(source).cast("bigint"), entry]
    uses = F.try_element_at(F.create_map(*pairs), F.col(axis).cast("bigint"))
    if sig.is_complex:
        phase = phase_unwrap(sig, axis).cells.withColumnRenamed("value", "_ph")
        rows = sig.cells.join(phase, on=sig.keys()).withColumn("_mag", F.hypot("re", "im"))
        sums = {"_mag": F.sum(F.col("_u.w") * F.col("_mag")), "_ph": F.sum(F.col("_u.w") * F.col("_ph"))}
    else:
        rows, sums = sig.cells, {"value": F.sum(F.col("_u.w") * F.col("value"))}
    fixed = (
        rows.withColumn("_u", F.explode(uses))
        .groupBy(*sig.keys(axis), F.col("_u.t").alias(axis))
        .agg(*(e.alias(n) for n, e in sums.items()))
    )
    if sig.is_complex:
        fixed = fixed.withColumns({"re": F.col("_mag") * F.cos("_ph"), "im": F.col("_mag") * F.sin("_ph")})
    columns = [*sig.keys(), *sig.parts]
    kept = sig.cells.where(~F.col(axis).isin([t for t, _, _ in weights]))
    return sig.with_cells(kept.select(columns).unionByName(fixed.select(columns)))


def _first_hit(sig: Signal, threshold: float, axis: str) -> DataFrame:
    """Cells with ``_first``: the first tap at or above the peak-power share."""
    w = Window.partitionBy(*sig.keys(axis))
    rows = sig.cells.withColumn("_pow", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    rows = rows.withColumn("_peak", F.max("_pow").over(w))
    hit = F.when(F.col("_pow") >= threshold * F.col("_peak"), F.col(axis))
    return rows.withColumn("_first", F.min(hit).over(w))


def leading_edge(sig: Signal, threshold: float = 0.5, axis: str = "tap") -> Signal:
    """Zero every tap before the leading edge; the tap index stays."""
    sig.require(axis, kind="complex")
    rows = _first_hit(sig, threshold, axis)
    parts = {p: F.when(F.col(axis) >= F.col("_first"), F.col(p)).otherwise(0.0) for p in ("re", "im")}
    return sig.with_cells(rows.withColumns(parts))


def time_of_arrival(sig: Signal, threshold: float = 0.5, axis: str = "tap") -> DataFrame:
    """Per series: leading tap, arrival time and range, from ``samples.bandwidth``."""
    sig.require(axis, kind="complex")
    first = _first_hit(sig, threshold, axis).groupBy(*sig.keys(axis)).agg(F.min("_first").alias("tap_index"))
    toa = F.col("tap_index") / F.col("bandwidth")
    return first.join(sig.samples.select(KEY, "bandwidth"), on=KEY).select(
        *sig.keys(axis), "tap_index", toa.alias("toa"), (SPEED_OF_LIGHT * toa / 2.0).alias("range_m")
    )


# Default BLE channel hop sequence.
BLE_HOPS = (
    0, 6, 12, 18, 24, 30, 36, 5, 11, 17, 23, 29, 35, 4, 10, 16, 22, 28, 34, 3,
    9, 15, 21, 27, 33, 2, 8, 14, 20, 26, 32, 1, 7, 13, 19, 25, 31,
)


def channel_hop_reorder(
    sig: Signal, hops: Sequence[int] = BLE_HOPS, axis: str = "channel", sizes: dict[str, int] | None = None
) -> Signal:
    """Channels in hop order; channels outside the sequence follow in order."""
    sig.require(axis, kind="real")
    rows = with_lengths(sig, axis, sizes=sizes)
    channel, count = F.col(axis), F.col(f"_len_{axis}")
    sequence = F.array(*(F.lit(h).cast("bigint") for h in hops))
    at = F.array_position(sequence, channel.cast("bigint")).cast("int")

    def listed(array: Column, below: Column) -> Column:
        return F.size(F.filter(array, lambda h: h < below))

    in_hops = listed(F.slice(sequence, F.lit(1), F.greatest(at - 1, F.lit(0))), count)
    after = listed(sequence, count) + channel - listed(sequence, channel)
    place = F.when(at > 0, in_hops).otherwise(after).cast("bigint")
    return sig.with_cells(rows.withColumn(axis, place))


def extract_segments(sig: Signal, segments: DataFrame, axis: str = "time", span: int = 4096) -> Signal:
    """Cut annotated half-open intervals ``(sample_id, segment, start, end, label)``.

    Time restarts at 0 per segment; empty intervals drop. Intervals and cells
    meet on (sample, time bucket), so no sample joins all its cells with all
    its segments.
    """
    sig.require(axis)
    wanted = segments.where(F.col("end") > F.col("start")).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("start") / F.lit(span)), F.floor((F.col("end") - 1) / F.lit(span))))
    )
    cells = sig.cells.withColumn("_bucket", F.floor(F.col(axis) / F.lit(span)))
    rows = cells.join(wanted.select(KEY, "_bucket", "segment", "start", "end"), on=[KEY, "_bucket"]).where(
        (F.col(axis) >= F.col("start")) & (F.col(axis) < F.col("end"))
    )
    return sig.with_cells(
        rows.withColumn(axis, F.col(axis) - F.col("start")), ["segment", *sig.axes], {axis: None}
    )


def frame_groups(
    sig: Signal, group: int, axis: str = "frame", sizes: dict[str, int] | None = None
) -> Signal:
    """For every target frame, the frames around it, clamped to the scene.

    Adds axis ``group``; each source cell emits itself to the targets that use
    it, so cells are never joined with cells.
    """
    sig.require(axis)
    rows = with_lengths(sig, axis, sizes=sizes)
    f, last, half = F.col(axis).cast("bigint"), F.col(f"_len_{axis}") - 1, group // 2
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(group - 1).cast("bigint"))

    def use(t: Column, g: Column) -> Column:
        return F.struct(t.alias("t"), g.alias("g"))

    inner = F.filter(F.transform(slots, lambda g: use(f + half - g, g)), lambda u: (u["t"] >= 0) & (u["t"] <= last))

    def beyond(targets: Column, outside) -> Column:
        """Slots of the targets near an end that would leave the scene there."""
        pairs = F.flatten(F.transform(targets, lambda t: F.transform(slots, lambda g: use(t, g))))
        return F.filter(pairs, lambda u: outside(u["t"] - half + u["g"]))

    none = F.array().cast("array<struct<t:bigint,g:bigint>>")
    head = beyond(F.sequence(F.lit(0).cast("bigint"), F.least(last, F.lit(group).cast("bigint"))), lambda p: p < 0)
    tail = beyond(F.sequence(F.greatest(F.lit(0).cast("bigint"), last - group), last), lambda p: p > last)
    uses = F.concat(inner, F.when(f == 0, head).otherwise(none), F.when(f == last, tail).otherwise(none))
    rows = rows.withColumn("_use", F.explode(uses))
    out = rows.withColumns({axis: F.col("_use.t"), "group": F.col("_use.g")})
    at = sig.axes.index(axis) + 1
    return sig.with_cells(out, [*sig.axes[:at], "group", *sig.axes[at:]], {"group": group})


def center_frames(
    sig: Signal, count: int, axis: str = "proc_chirp", new_axis: str = "frame", sizes: dict[str, int] | None = None
) -> Signal:
    """The ``count`` indexes around the middle of an axis, renamed."""
    sig.require(axis)
    rows = with_lengths(sig, axis, sizes=sizes)
    start = F.floor(F.col(f"_len_{axis}") / F.lit(2)) - count // 2
    kept = rows.where((F.col(axis) >= start) & (F.col(axis) < start + count))
    names = [new_axis if a == axis else a for a in sig.axes]
    return sig.with_cells(
        kept.withColumn(axis, F.col(axis) - start).withColumnRenamed(axis, new_axis), names, {new_axis: count}
    )


def select_view(sig: Signal, view: str, views: dict[str, int]) -> Signal:
    return select_index(sig, view=views[view])


def center_group(sig: Signal, axis: str = "group", sizes: dict[str, int] | None = None) -> Signal:
    """The middle index of the group axis; the axis drops."""
    sig.require(axis)
    rows = with_lengths(sig, axis, sizes=sizes)
    kept = rows.where(F.col(axis) == F.floor(F.col(f"_len_{axis}") / F.lit(2)))
    return sig.with_cells(kept, [a for a in sig.axes if a != axis])


def remove_static_clutter(sig: Signal, axis: str = "chirp") -> Signal:
    """Subtract the mean along an axis."""
    sig.require(axis)
    df = with_statistics(sig, sig.keys(axis), *(F.avg(p).alias(f"_m_{p}") for p in sig.parts))
    return sig.with_cells(df.withColumns({p: F.col(p) - F.col(f"_m_{p}") for p in sig.parts}))
