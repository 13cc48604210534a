"""Small constant matrices for the linear signal operators.

Each is T x T or smaller, T being the bins of one window; none grows with the data. Every builder
returns the matrix of a linear map, so a whole Arrow batch of signals goes through one product.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Complex Morlet bandwidth, centre frequency, half support, sample count.
MORLET_B = 1.5
MORLET_C = 1.0
MORLET_HALF = 8.0
MORLET_SAMPLES = 4096


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


@lru_cache(maxsize=64)
def gaussian_matrix(n: int, sigma: float) -> np.ndarray:
    """Row t holds the smoothing weights of bin t; the edge value repeats outside."""
    if sigma <= 0:
        return np.eye(n)
    taps = gaussian_taps(sigma)
    radius = len(taps) // 2
    out = np.zeros((n, n))
    for t in range(n):
        src = np.clip(np.arange(t - radius, t + radius + 1), 0, n - 1)
        np.add.at(out[t], src, taps)
    return out


@lru_cache(maxsize=64)
def box_matrix(n: int, width: int = 5) -> np.ndarray:
    """Moving average, zero outside the window."""
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    return (np.abs(lag) <= width // 2) / float(width)


@lru_cache(maxsize=64)
def lerp_matrix(n_src: int, n_dst: int) -> np.ndarray:
    """Linear resampling of n_src points onto n_dst points, both spanning [0, 1]."""
    eye = np.eye(n_src)
    src, dst = np.linspace(0, 1, n_src), np.linspace(0, 1, n_dst)
    return np.stack([np.interp(dst, src, eye[i]) for i in range(n_src)], axis=1)


@lru_cache(maxsize=1)
def _morlet_integral() -> tuple[np.ndarray, float]:
    x = np.linspace(-MORLET_HALF, MORLET_HALF, MORLET_SAMPLES)
    psi = np.exp(2j * np.pi * MORLET_C * x - x**2 / MORLET_B) / np.sqrt(np.pi * MORLET_B)
    step = x[1] - x[0]
    return np.conj(np.cumsum(psi) * step), step


@lru_cache(maxsize=256)
def cwt_matrix(n: int, freq: float, dt: float) -> np.ndarray:
    """Complex n x n map of a signal to its wavelet coefficients at one frequency."""
    integral, step = _morlet_integral()
    scale = MORLET_C / (freq * dt)
    idx = (np.arange(scale * 2 * MORLET_HALF + 1) / (scale * step)).astype(int)
    taps = integral[idx[idx < MORLET_SAMPLES]][::-1]
    centre = (len(taps) - 2) // 2
    lag = np.arange(n)[:, None] - np.arange(n)[None, :] + centre

    def at(i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < len(taps))
        return np.where(inside, taps[np.clip(i, 0, len(taps) - 1)], 0)

    return -np.sqrt(scale) * (at(lag + 1) - at(lag))


def mean_removal(n: int) -> np.ndarray:
    return np.eye(n) - 1.0 / n


def band_frequencies(lo: float, hi: float, n_freqs: int = 6) -> np.ndarray:
    return np.geomspace(max(lo, 0.5), hi, n_freqs)


def power_frequencies(n_freq: int) -> np.ndarray:
    """Frequency grid of the magnitude maps, 4 to 80 Hz."""
    return np.geomspace(4.0, 80.0, n_freq)


def cwt_band_factors(n: int, dt: float, bands: dict, sigma_bins: float, n_freqs: int = 6) -> dict[str, np.ndarray]:
    """Per band a matrix V with band power of counts x equal to the squared length of x V.

    Smoothing, mean removal and the wavelet are linear, so mean power over the middle bins is a
    quadratic form of the counts; its eigenvectors are V.
    """
    front = mean_removal(n) @ gaussian_matrix(n, sigma_bins) / dt
    keep = slice(int(0.1 * n), int(0.9 * n))
    out = {}
    for name, (lo, hi) in bands.items():
        freqs = band_frequencies(lo, hi, n_freqs)
        rows = [cwt_matrix(n, float(f), dt)[keep] @ front for f in freqs]
        form = np.mean([(a.conj().T @ a).real / a.shape[0] for a in rows], axis=0)
        lam, vec = np.linalg.eigh(form)
        use = lam > lam.max() * 1e-14
        out[name] = vec[:, use] * np.sqrt(lam[use])
    return out


@lru_cache(maxsize=16)
def stft_even_matrix(n: int, dt: float, win_ms: float = 300.0) -> tuple[np.ndarray, np.ndarray]:
    """(freqs, complex map [frame, freq, bin]) of a one-bin-hop Hann transform, mirrored at both ends."""
    nper = max(8, int(round(win_ms / (dt * 1000.0))))
    half = nper // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)
    freqs = np.fft.rfftfreq(nper, dt)
    n_frames = n + 2 * half - nper + 1
    pos = np.arange(n_frames)[:, None] + np.arange(nper)[None, :] - half
    mirrored = np.abs(pos)
    mirrored = np.where(mirrored > n - 1, 2 * (n - 1) - mirrored, mirrored)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(len(freqs)), np.arange(nper)) / nper) * window / window.sum()
    out = np.zeros((n_frames, len(freqs), n), complex)
    for frame in range(n_frames):
        for m in range(nper):
            out[frame, :, mirrored[frame, m]] += wave[:, m]
    return freqs, out @ mean_removal(n)


@lru_cache(maxsize=16)
def stft_zero_matrix(n: int) -> np.ndarray | None:
    """Complex map [frame, freq, bin] of a half-overlapping Hann transform with zeros outside."""
    nper = min(32, max(8, n // 4))
    if n < nper:
        return None
    hop, half = nper - nper // 2, nper // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nper) / nper)
    extended = n + 2 * half
    extended += (-(extended - nper) % hop) % nper
    n_frames = (extended - nper) // hop + 1
    wave = np.exp(-2j * np.pi * np.outer(np.arange(nper // 2 + 1), np.arange(nper)) / nper) * window / window.sum()
    out = np.zeros((n_frames, nper // 2 + 1, n), complex)
    for frame in range(n_frames):
        for m in range(nper):
            bin_ = frame * hop + m - half
            if 0 <= bin_ < n:
                out[frame, :, bin_] += wave[:, m]
    return out
