"""Audio in: file and URL scans, WAV decoding, mono mix and resampling, one row per recording."""

from __future__ import annotations

import io
import urllib.request
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import text as T

RATE = 16_000
SCHEMA = "rec string, sample_rate int, samples array<float>"


def decode_wav(content: bytes) -> tuple[np.ndarray, int, int]:
    """(interleaved samples in -1..1, sample rate, channels) of PCM audio; a partial last frame is dropped."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels() or 1, w.getframerate()
        raw = w.readframes(w.getnframes())
    if not rate:
        raise ValueError("audio without a sample rate")
    raw = raw[: len(raw) // width * width]
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128, rate, channels
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23, rate, channels
    kind = {2: "<i2", 4: "<i4"}[width]
    return np.frombuffer(raw, kind).astype(np.float32) / 2 ** (8 * width - 1), rate, channels


#: Decoders by extension; further ones are added here. Unknown extensions are tried as WAV.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int, int]]] = {"wav": decode_wav}


def decode(content: bytes, extension: str | None = None, rate: int = RATE) -> np.ndarray:
    """Mono samples at `rate`; channels are mixed before resampling, empty audio stays empty."""
    samples, source, channels = DECODERS.get(extension or "", decode_wav)(content)
    if channels > 1:
        samples = S.mono(samples, channels)
    return S.resample(samples, source, rate)


def fetch(url: str) -> bytes:
    """The body of a URL; an error status raises."""
    with urllib.request.urlopen(url) as r:
        return r.read()


def decoded(files: DataFrame, rate: int = RATE) -> DataFrame:
    """(rec, sample_rate, samples) from (path, content); the path's extension picks the decoder."""

    def run(batches):
        for b in batches:
            samples = [decode(bytes(c), e, rate) for c, e in zip(b["content"], b["extension"], strict=True)]
            yield pd.DataFrame({"rec": b["path"], "sample_rate": rate, "samples": samples})

    return files.select("path", "content", T.path_extension(F.col("path")).alias("extension")).mapInPandas(run, SCHEMA)


def read_audio(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """Decoded audio files below a path or glob; a missing path raises."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), rate)


def read_audio_urls(urls: DataFrame, rate: int = RATE) -> DataFrame:
    """Decoded audio of a column `path` of URLs, fetched where the partitions are."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [fetch(u) for u in b["path"]]})

    return decoded(urls.where(T.is_url(F.col("path"))).select("path").mapInPandas(run, "path string, content binary"), rate)
