"""Signal operators on array columns: one row in, one row out, no shuffle.

Light filters are array expressions. Transforms with a dense kernel are Arrow UDFs that push a whole
batch of signals through one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K

#: Values of signals that go through one product.
PIECE = 1 << 15
KINDS = {
    "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64())),
}


def rate(counts: Column, bin_s: float) -> Column:
    return F.transform(counts, lambda x: x.cast("double") / F.lit(bin_s))


def sqrt_counts(counts: Column) -> Column:
    return F.transform(counts, lambda x: F.sqrt(x.cast("double")))


def log_power(power: Column) -> Column:
    return F.transform(power, lambda x: F.log1p(x))


def gaussian_smooth(values: Column, sigma_bins: float) -> Column:
    """Gaussian filter; the edge value repeats outside the array."""
    taps = [float(w) for w in K.gaussian_taps(sigma_bins)]
    radius = len(taps) // 2
    last = F.size(values) - 1

    def at(i: Column, offset: int) -> Column:
        return F.get(values, F.least(F.greatest(i + offset, F.lit(0)), last)).cast("double")

    def smooth(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(taps):
            total = total + at(i, k - radius) * F.lit(w)
        return total

    return F.transform(values, smooth)


def box_smooth(values: Column, width: int = 5) -> Column:
    """Moving average with zeros outside the array, same length."""
    half = width // 2

    def smooth(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k in range(-half, half + 1):
            inside = F.when(i + k >= 0, F.get(values, i + k).cast("double"))
            total = total + F.coalesce(inside, F.lit(0.0)) * F.lit(1.0 / width)
        return total

    return F.transform(values, smooth)


def resample(values: Column, n: int) -> Column:
    """Linear interpolation onto n points over the same span."""
    last = (F.size(values) - 1).cast("double")

    def point(i: Column) -> Column:
        x = i.cast("double") * last / F.lit(float(max(n - 1, 1)))
        low = F.least(F.floor(x), last).cast("int")
        a = F.get(values, low).cast("double")
        b = F.coalesce(F.get(values, low + 1).cast("double"), a)
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def fit_length(values: Column, n: Column) -> Column:
    """Crop or zero-pad to n elements."""
    zero = F.lit(0).cast("int")
    padded = F.concat(values, F.array_repeat(zero, F.greatest(n - F.size(values), F.lit(0)).cast("int")))
    return F.slice(padded, F.lit(1), n)


def keep_last(values: Column, k: int) -> Column:
    """Only the last k bins."""
    return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k))


def keep_first(values: Column, k: int) -> Column:
    return F.slice(values, F.lit(1), F.lit(k))


def shift_times(values: Column, anchor: Column) -> Column:
    """Times relative to an epoch anchor."""
    return F.transform(values, lambda t: t - anchor)


def _by_length(signals: pa.Array, fn: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Run fn on the stacked signals of each length; NULL and empty signals give NULL."""
    lengths = pc.fill_null(pc.list_value_length(signals), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = signals.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    rows, parts = [], []
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        rows.append(at)
        parts.append(_nested(fn(values[starts[at][:, None] + np.arange(n)])))
    absent = np.flatnonzero(lengths == 0)
    if len(absent):
        rows.append(absent)
        parts.append(pa.nulls(len(absent), parts[0].type if parts else pa.null()))
    if len(parts) == 1:
        return parts[0]
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))


def _nested(block: np.ndarray) -> pa.Array:
    """A block as an array of its rows, whose inner dimensions are lists; NaN is NULL."""
    out = pa.array(block.ravel(), from_pandas=True)
    for k in range(block.ndim - 1, 0, -1):
        outer = int(np.prod(block.shape[:k]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(outer + 1) * block.shape[k], pa.int32()), out)
    return out


def _array_udf(fn: Callable[[np.ndarray], np.ndarray], returns: str):
    """A batch is taken in pieces of `PIECE` values, so that a worker's memory does not follow the size of a batch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = KINDS[returns]
        for batch in batches:
            step = max(1, PIECE // (pc.max(pc.list_value_length(batch)).as_py() or 1))
            for k in range(0, len(batch), step):
                yield _by_length(batch.slice(k, step), fn).cast(kind)

    return F.arrow_udf(run, returns)


def band_power_cwt(counts: Column, bin_s: float, bands: dict, sigma_bins: float = 2.0, n_freqs: int = 6) -> Column:
    """array<double>: mean wavelet power of the smoothed rate per band, in band order."""

    def run(x: np.ndarray) -> np.ndarray:
        factors = K.cwt_band_factors(x.shape[1], bin_s, bands, sigma_bins, n_freqs)
        return np.stack([((x @ v) ** 2).sum(axis=1) for v in factors.values()], axis=1)

    return _array_udf(run, "array<double>")(counts)


def band_power_stft(rates: Column, bin_s: float, bands: dict) -> Column:
    """array<array<double>>: band x bin short-time power."""

    def run(x: np.ndarray) -> np.ndarray:
        freqs, kernel = K.stft_even_matrix(x.shape[1], bin_s)
        power = np.abs(np.einsum("rn,tfn->rtf", x, kernel)) ** 2
        back = K.lerp_matrix(power.shape[1], x.shape[1])
        out = []
        for lo, hi in bands.values():
            m = (freqs >= lo) & (freqs < hi)
            band = power[:, :, m].mean(axis=2) if m.any() else np.zeros(power.shape[:2])
            out.append(band @ back.T)
        return np.stack(out, axis=1)

    return _array_udf(run, "array<array<double>>")(rates)


def cwt_scalogram(rates: Column, bin_s: float, freqs: list[float]) -> Column:
    """array<array<double>>: frequency x bin wavelet power of the mean-removed rate."""

    def run(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=1, keepdims=True)
        return np.stack([np.abs(x @ K.cwt_matrix(x.shape[1], f, bin_s).T) ** 2 for f in freqs], axis=1)

    return _array_udf(run, "array<array<double>>")(rates)


def _wavelet_mag(x: np.ndarray, bin_s: float, n_freq: int) -> np.ndarray:
    n = x.shape[1]
    if n < 8:
        return _stft_mag(x, n_freq)
    smooth = x @ K.box_matrix(n).T
    return np.stack(
        [np.abs(smooth @ K.cwt_matrix(n, float(f), bin_s).T) for f in K.power_frequencies(n_freq)], axis=1
    )


def _stft_mag(x: np.ndarray, n_freq: int) -> np.ndarray:
    n = x.shape[1]
    kernel = K.stft_zero_matrix(n)
    if kernel is None:
        return np.zeros((x.shape[0], n_freq, n))
    mag = np.abs(np.einsum("rn,tfn->rft", x @ K.box_matrix(n).T, kernel))
    freq = K.lerp_matrix(mag.shape[1], n_freq)
    time = K.lerp_matrix(mag.shape[2], n)
    return np.einsum("gf,rft,ut->rgu", freq, mag, time)


def wavelet_magnitude(counts: Column, bin_s: float, n_freq: int = 16) -> Column:
    return _array_udf(lambda x: _wavelet_mag(x, bin_s, n_freq), "array<array<double>>")(counts)


def stft_magnitude(counts: Column, n_freq: int = 16) -> Column:
    return _array_udf(lambda x: _stft_mag(x, n_freq), "array<array<double>>")(counts)


def mean_map(a: Column, b: Column) -> Column:
    """Cell-wise mean of two frequency x bin maps."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: (u + v) * 0.5))


def wavelet_band_energy(counts: Column, bin_s: float, lo: float, hi: float, n_freq: int = 12) -> Column:
    """Mean wavelet magnitude over [lo, hi] Hz and all bins."""
    use = band_rows(n_freq, lo, hi)

    return _array_udf(lambda x: _wavelet_mag(x, bin_s, n_freq)[:, use].mean(axis=(1, 2)), "double")(counts)


def band_rows(n_freq: int, lo: float, hi: float) -> list[int]:
    """Rows of a magnitude map inside [lo, hi] Hz; all rows when none are."""
    f = K.power_frequencies(n_freq)
    rows = np.flatnonzero((f >= lo) & (f <= hi)).tolist()
    return rows or list(range(n_freq))


def band_energy(tf_map: Column, n_freq: int, lo: float, hi: float) -> Column:
    """Mean of a magnitude map over the rows in [lo, hi] Hz."""
    rows = band_rows(n_freq, lo, hi)
    cells = F.flatten(F.slice(tf_map, rows[0] + 1, len(rows)))
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)


def significant(value: Column, digits: int = 9) -> Column:
    """A value rounded to significant digits, so that ties don't depend on its unit; below 1e-20 it is rounding noise, 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    return F.when(F.abs(value) < 1e-20, 0.0).otherwise(F.round(value / power, digits - 1) * power)
