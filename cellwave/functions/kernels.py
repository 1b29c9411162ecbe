"""Vectorised numpy kernels over packed series, run as Arrow pandas UDFs.

Spark decides which series share a batch; a kernel only maps the stacked
arrays of one batch. Rows of equal length and equal flags are stacked.
"""

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

COMPLEX = "struct<re:array<double>,im:array<double>>"


def _run(fn, re, im, flags):
    """Apply ``fn(block, *flags)`` to stacked rows; returns one array per row."""
    same = defaultdict(list)
    extras = [f.tolist() for f in flags]
    for i, values in enumerate(re):
        same[(len(values), *(e[i] for e in extras))].append(i)
    out = [None] * len(re)
    for key, rows in same.items():
        block = np.stack([np.asarray(re.iloc[i], dtype=np.float64) for i in rows])
        if im is not None:
            block = block + 1j * np.stack([np.asarray(im.iloc[i], dtype=np.float64) for i in rows])
        result = np.asarray(fn(block, *key[1:]))
        for i, row in zip(rows, result.reshape(len(rows), -1)):
            out[i] = row
    return out


def _split(rows) -> pd.DataFrame:
    return pd.DataFrame({
        "re": [np.ascontiguousarray(r.real) for r in rows],
        "im": [np.ascontiguousarray(np.imag(r)) for r in rows],
    })


def array_kernel(fn: Callable, parts: list[str], *flags: Column, real: bool = False) -> Column:
    """Column of kernel results: ``struct<re,im>`` arrays, or one array if ``real``.

    ``fn(block, *flags)`` gets a ``[rows, length]`` array, complex when there
    are two parts, and returns the same number of rows.
    """
    if len(parts) == 2:

        def both(re, im, extra):
            return _run(fn, re, im, extra)

        if real:

            @pandas_udf("array<double>")
            def run(re: pd.Series, im: pd.Series, *extra: pd.Series) -> pd.Series:
                return pd.Series([np.real(r) for r in both(re, im, extra)])
        else:

            @pandas_udf(COMPLEX)
            def run(re: pd.Series, im: pd.Series, *extra: pd.Series) -> pd.DataFrame:
                return _split(both(re, im, extra))
    elif real:

        @pandas_udf("array<double>")
        def run(re: pd.Series, *extra: pd.Series) -> pd.Series:
            return pd.Series([np.real(r) for r in _run(fn, re, None, extra)])
    else:

        @pandas_udf(COMPLEX)
        def run(re: pd.Series, *extra: pd.Series) -> pd.DataFrame:
            return _split(_run(fn, re, None, extra))

    return run(*(F.col(p) for p in parts), *flags)


def periodic_window(name: str | None, size: int) -> np.ndarray:
    """Periodic (not symmetric) window of a given length."""
    phase = 2.0 * np.pi * np.arange(size) / size
    if name in (None, "none", "rect"):
        return np.ones(size)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(phase)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(phase)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(phase) + 0.08 * np.cos(2 * phase)
    raise ValueError(f"unknown window {name!r}")


def gaussian_window(size: int, std: float) -> np.ndarray:
    return np.exp(-0.5 * ((np.arange(size) - size / 2.0) / std) ** 2)


def butterworth(order: int, cutoff_hz: float, rate: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth coefficients ``(b, a)`` by the bilinear transform.

    The numerator is scaled to unit gain in the pass band (DC or Nyquist).
    """
    if kind not in ("low", "high"):
        raise ValueError(f"filter kind must be low or high, got {kind!r}")
    if order < 1 or not 0.0 < cutoff_hz < rate / 2.0:
        raise ValueError(f"need order >= 1 and 0 < cutoff < {rate / 2.0}, got {order}, {cutoff_hz}")
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = np.tan(np.pi * cutoff_hz / rate)
    analog = prototype * warped if kind == "low" else warped / prototype
    a = np.poly((1.0 + analog) / (1.0 - analog)).real
    zero = -1.0 if kind == "low" else 1.0
    b = np.poly(np.full(order, zero)).real
    passband = (-zero) ** np.arange(order + 1)
    return b * (a @ passband) / (b @ passband), a


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state after an endless constant input of one."""
    gain = b.sum() / a.sum()
    return np.cumsum((b[1:] - a[1:] * gain)[::-1])[::-1]


def iir(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
    """Causal IIR filter of every row, block by block as matrix products."""
    return iir_states(x, b, a, state, block)[0]


def iir_states(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The filtered rows and the state that each leaves behind."""
    order = len(a) - 1
    step = state_step(a)
    drive = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    from_state = np.stack([p[0] for p in powers[:block]])
    impulse = np.concatenate([[b[0]], from_state[: block - 1] @ drive])
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    toeplitz = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    to_state = np.stack([powers[block - 1 - m] @ drive for m in range(block)], axis=1)
    out = np.empty_like(x)
    for start in range(0, x.shape[1], block):
        part = x[:, start : start + block]
        m = part.shape[1]
        out[:, start : start + m] = state @ from_state[:m].T + part @ toeplitz[:m, :m].T
        state = state @ powers[m].T + part @ to_state[:, block - m :].T
    return out, state


def state_step(a: np.ndarray) -> np.ndarray:
    """How a filter's state moves on in one sample without input."""
    step = np.eye(len(a) - 1, k=1)
    step[:, 0] -= a[1:]
    return step


def decay_length(a: np.ndarray, tolerance: float = 1e-18) -> int:
    """Steps after which a filter has forgotten its state to the tolerance."""
    radius = float(np.abs(np.roots(a)).max()) if len(a) > 1 else 0.0
    if radius >= 1.0:
        raise ValueError("filter is not stable")
    return 1 if radius == 0.0 else int(np.ceil(np.log(tolerance) / np.log(radius)))


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray, head: bool = True, tail: bool = True) -> np.ndarray:
    """Forward-backward filter; odd extension at the ends that are real ends."""
    edge = 3 * len(a)
    if (head or tail) and x.shape[1] <= edge:
        raise ValueError(f"series of length {x.shape[1]} is not longer than the padding {edge}")
    left = 2 * x[:, :1] - x[:, edge:0:-1] if head else x[:, :0]
    right = 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1] if tail else x[:, :0]
    extended = np.concatenate([left, x, right], axis=1)
    settled = steady_state(b, a)
    forward = iir(extended, b, a, extended[:, :1] * settled)
    backward = iir(forward[:, ::-1], b, a, forward[:, -1:] * settled)[:, ::-1]
    return backward[:, left.shape[1] : left.shape[1] + x.shape[1]]


#: Widest window that is sorted as a strided view; wider ones are ranked in a wavelet matrix.
SORTED_WINDOW = 64


class RangeRanks:
    """Order statistics of any stretches of an array of distinct ranks ``0..n-1``: a wavelet matrix.

    Level by level the numbers are dealt by one bit, zeros first; a count of zeros leads a stretch from one level to
    the next, so a query costs one step a bit whatever the stretch's length, and all stretches are asked at once.
    """

    def __init__(self, ranks: np.ndarray) -> None:
        self.bits = max(int(len(ranks) - 1).bit_length(), 1)
        self.zeros, self.split = [], []
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit & 1) == 0
            self.zeros.append(np.append(0, np.cumsum(zero)))
            self.split.append(int(self.zeros[-1][-1]))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest rank (from 0) of each stretch ``[low, high)``."""
        low, high, k, out = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            a, b = zeros[low], zeros[high]
            up = k >= b - a
            out = out * 2 + up
            k = np.where(up, k - (b - a), k)
            low, high = np.where(up, split + low - a, a), np.where(up, split + high - b, b)
        return out


def _window_medians(rank: np.ndarray, mag: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-median modulus, lower-median deviation from it and upper-median rank of each window; ``mag`` is by rank."""
    n = len(rank)
    at = np.arange(n)
    low, high = np.maximum(at - half, 0), np.minimum(at + half + 1, n)
    size = high - low
    lower, upper = (size + 1) // 2 - 1, size // 2
    if 2 * half + 1 <= SORTED_WINDOW:
        padded = np.concatenate([np.full(half, n), rank, np.full(half, n)])
        inside = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
        median = mag[inside[at, lower]]
        gaps = np.sort(np.abs(np.append(mag, np.inf)[inside] - median[:, None]), axis=1)
        return median, gaps[at, lower], inside[at, upper]
    ranks = RangeRanks(rank)
    median = mag[ranks.smallest(low, high, lower)]
    # deviations fall up to the median and rise after it: of the lower + 1 nearest cells, find where the first is
    first, last = np.zeros(n, np.int64), size - 1 - lower
    while (open_ := first < last).any():
        middle = (first + last) // 2
        left = median - mag[ranks.smallest(low, high, middle)]
        right = mag[ranks.smallest(low, high, np.minimum(middle + lower + 1, size - 1))] - median
        first = np.where(open_ & (left > right), middle + 1, first)
        last = np.where(open_ & ~(left > right), middle, last)
    ends = [np.abs(mag[ranks.smallest(low, high, k)] - median) for k in (first, first + lower)]
    return median, np.maximum(*ends), ranks.smallest(low, high, upper)


def hampel(x: np.ndarray, half: int, limit: float) -> np.ndarray:
    """Each row with its outliers replaced by their window's upper-median cell, ties by parts; NaN is the largest."""
    out = np.array(x)
    for row, own in zip(out, x if x.size else x[:0]):
        mag = np.abs(own)
        order = np.lexsort((np.imag(own), np.real(own), mag))
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        median, deviation, upper = _window_medians(rank, mag[order], half)
        gap, most = np.abs(mag - median), limit * deviation
        row[:] = np.where((gap > most) | (np.isnan(gap) & ~np.isnan(most)), own[order[upper]], own)
    return out
