"""NumPy kernels for dense signals; used inside Arrow batches, never row by row from SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class FbankConfig:
    sample_rate: int = 16_000
    frame_ms: float = 25.0
    hop_ms: float = 10.0
    bins: int = 80
    pre_emphasis: float = 0.97

    @property
    def frame(self) -> int:
        return int(self.sample_rate * self.frame_ms / 1000)

    @property
    def hop(self) -> int:
        return int(self.sample_rate * self.hop_ms / 1000)

    @property
    def fft(self) -> int:
        return 1 << (self.frame - 1).bit_length()


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    n = len(samples) // channels
    return samples[: n * channels].reshape(n, channels).mean(axis=1, dtype=np.float32)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate, without a filter; the identity for equal rates and empty input."""
    if source == target or not len(samples):
        return samples
    ratio = source / target
    at = np.arange(int(np.ceil(len(samples) / ratio))) * ratio
    low = np.minimum(at.astype(np.int64), len(samples) - 1)
    high = np.minimum(low + 1, len(samples) - 1)
    part = (at - np.floor(at)).astype(np.float32)
    return (samples[low] + part * (samples[high] - samples[low])).astype(np.float32)


def hamming(n: int) -> np.ndarray:
    return np.ones(1) if n <= 1 else 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def power_spectrum(frames: np.ndarray, fft: int) -> np.ndarray:
    return np.abs(np.fft.rfft(frames, fft, axis=-1)) ** 2 / fft


def mel_filterbank(bins: int, fft: int, rate: int) -> np.ndarray:
    """Triangles between fractional bins that are evenly spaced in mel; (bins, fft // 2 + 1), no area norm."""
    mel = np.linspace(0, 1127 * np.log(1 + rate / 2 / 700), bins + 2)
    edges = 700 * (np.exp(mel / 1127) - 1) * fft / rate
    k = np.arange(fft // 2 + 1)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up = np.where((k > left) & (k <= centre), (k - left) / (centre - left), 0)
    return up + np.where((k > centre) & (k < right), (right - k) / (right - centre), 0)


def fbank(samples: np.ndarray, config: FbankConfig | None = None) -> np.ndarray:
    """Log mel energies, (frames, bins); input shorter than a frame is one frame with zeros behind, none gives none."""
    c = config or FbankConfig()
    x = np.asarray(samples, float)
    if not len(x):
        return np.zeros((0, c.bins))
    x = np.concatenate([x[:1], x[1:] - c.pre_emphasis * x[:-1]])
    if len(x) < c.frame:
        x = np.concatenate([x, np.zeros(c.frame - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, c.frame)[:: c.hop] * hamming(c.frame)
    return np.log(np.maximum(power_spectrum(frames, c.fft) @ mel_filterbank(c.bins, c.fft, c.sample_rate).T, EPSILON))


def speaker_samples(samples: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The samples of active frames in a row; frames share the samples given evenly, so a short last window is squeezed."""
    if not len(active) or not len(samples):
        return samples[:0]
    per = np.float32(len(samples)) / np.float32(len(active))
    start = (np.arange(len(active)) * per).astype(int)
    end = np.minimum(((np.arange(len(active)) + 1) * per).astype(int), len(samples))
    parts = [samples[a:b] for a, b, on in zip(start, end, active, strict=True) if on]
    return np.concatenate(parts) if parts else samples[:0]


def lda(x: np.ndarray, mean: np.ndarray, transform: np.ndarray, dims: int = 128) -> np.ndarray:
    """Centred, projected, cut to `dims` and normalised rows. A square matrix with fewer than `dims` rows isn't transposed."""
    x = np.asarray(x, float).copy()
    if not x.size:
        return np.zeros((0, dims))
    mean = np.asarray(mean, float).ravel()
    n = min(len(mean), x.shape[1])
    x[:, :n] -= mean[:n]
    rows, cols = transform.shape
    if cols == x.shape[1] and rows >= dims:
        x = x @ transform.T
    elif rows == x.shape[1]:
        x = x @ transform
    x = x[:, : min(x.shape[1], dims)]
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size > EPSILON, x / np.maximum(size, EPSILON), x)
