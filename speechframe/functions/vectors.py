"""Column functions over arrays: norms, distances, first-of-ties extremes, windows' weights, signals held as arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

F32_EPSILON = 1.1920928955078125e-07


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    # The norm stands in an array of its own, so that it is computed once and not for each element.
    scaled = lambda n: F.when(n > F32_EPSILON, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))
    return F.transform(F.array(norm(a)), scaled)[0]


def cosine_distance(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """1 - cosine; 1 where either is as good as zero. Norms may be given, so that a join computes them once per row."""
    scale = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(scale < F32_EPSILON, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def argmax_first(values: Column, suppressed: Column | None = None) -> Column:
    """The 0-based place of the first largest value that isn't suppressed; 0 where there is none. NaN never wins."""
    masked = F.transform(values, lambda x, i: F.when(F.isnan(x) | (F.array_contains(suppressed, i) if suppressed is not None else F.lit(False)), F.lit(None)).otherwise(x))
    return F.coalesce(F.array_position(masked, F.array_max(masked)) - 1, F.lit(0)).cast("int")


def hamming(i: Column, n: int) -> Column:
    return F.lit(1.0) if n <= 1 else 0.54 - 0.46 * F.cos(F.lit(2 * math.pi) * i / (n - 1))


def hz_to_mel(hz: Column) -> Column:
    return 1127.0 * F.log(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.exp(mel / 1127.0) - 1)


def mono(samples: Column, channels: int) -> Column:
    """The mean of each frame of interleaved samples; a last partial frame is dropped."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    total = lambda i: sum((F.get(samples, i * channels + c) for c in range(1, channels)), F.get(samples, i * channels))
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: total(i) / channels)).otherwise(F.slice(samples, 1, 0))


def padded_slice(samples: Column, start: Column, window: int) -> Column:
    """samples[start:start + window], with zeros behind."""
    part = F.slice(samples, start + 1, window)
    return F.concat(part, F.array_repeat(F.lit(0).cast("float"), F.lit(window) - F.size(part)))


def pre_emphasis(samples: Column, factor: float = 0.97) -> Column:
    return F.transform(samples, lambda x, i: F.when(i == 0, x).otherwise(x - factor * F.get(samples, i - 1)))
