"""Models behind one interface, and a deterministic backend with which every stage runs offline.

The test backend recognises no speech: its tokens, activity and vectors are simple functions of the samples.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import signal as S
from .decode import TokenSpec


class Backend(Protocol):
    frames: int
    speakers: int

    def tokens(self, chunk: np.ndarray, task: str, language: str | None) -> list[int]: ...

    def text(self, tokens: list[int]) -> str: ...

    def segment(self, window: np.ndarray) -> np.ndarray:
        """Scores (frames, speakers) of a window."""

    def embed(self, features: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class TestBackend:
    __test__ = False
    frames: int = 100
    speakers: int = 2
    dims: int = 16
    spec: TokenSpec = TokenSpec()

    def tokens(self, chunk: np.ndarray, task: str = "transcribe", language: str | None = None) -> list[int]:
        """A timestamp, three words and a timestamp for each third of the chunk, then the end."""
        first, out = self.spec.first_timestamp, []
        for k, part in enumerate(np.array_split(np.abs(chunk), 3)):
            loud = int(1000 * float(part.mean())) if len(part) else 0
            out += [first + 500 * k, *((loud + 7 * w) % 50_000 for w in range(3)), first + 500 * (k + 1)]
        return [*out, self.spec.end]

    def text(self, tokens: list[int]) -> str:
        return "".join(f" w{t}" for t in tokens)

    def segment(self, window: np.ndarray) -> np.ndarray:
        loud = np.array([np.abs(p).mean() if len(p) else 0 for p in np.array_split(window, self.frames)])
        half = loud > loud.mean() if len(loud) else loud
        return np.stack([np.where(half, 0.9, 0.1), np.where(~half & (loud > 0), 0.8, 0.2)], 1)[:, : self.speakers]

    def embed(self, features: np.ndarray) -> np.ndarray:
        return np.resize(features.mean(0) if len(features) else np.zeros(self.dims), self.dims)


def transcribe_chunks(chunks: DataFrame, backend: Backend, task: str = "transcribe", language: str | None = None) -> DataFrame:
    """(rec, chunk, pos, token) from (rec, chunk_idx, samples); chunks are independent of each other."""

    def run(batches):
        for b in batches:
            for rec, chunk, samples in zip(b["rec"], b["chunk_idx"], b["samples"], strict=True):
                tokens = backend.tokens(np.asarray(samples, np.float32), task, language)
                yield pd.DataFrame({"rec": rec, "chunk": chunk, "pos": range(len(tokens)), "token": tokens})

    return chunks.select("rec", "chunk_idx", "samples").mapInPandas(run, f"rec {dict(chunks.dtypes)['rec']}, chunk int, pos int, token long")


def token_text(segments: DataFrame, backend: Backend) -> DataFrame:
    """segments with text for tokens, and seg_idx over the whole recording."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda t: backend.text(list(t)))

    order = Window.partitionBy("rec").orderBy("chunk", "k")
    return segments.select("rec", (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), text("tokens").alias("text"), "start", "end")


def segment_windows(windows: DataFrame, backend: Backend) -> DataFrame:
    """(rec, chunk, frame, speaker, score) from (rec, chunk_idx, samples)."""

    def run(batches):
        for b in batches:
            for rec, chunk, samples in zip(b["rec"], b["chunk_idx"], b["samples"], strict=True):
                scores = backend.segment(np.asarray(samples, np.float32))
                frame, speaker = np.indices(scores.shape)
                yield pd.DataFrame({"rec": rec, "chunk": chunk, "frame": frame.ravel(), "speaker": speaker.ravel(), "score": scores.ravel()})

    return windows.select("rec", "chunk_idx", "samples").mapInPandas(run, f"rec {dict(windows.dtypes)['rec']}, chunk int, frame int, speaker int, score double")


def embed_speakers(windows: DataFrame, masks: DataFrame, backend: Backend) -> DataFrame:
    """(rec, chunk, speaker, embedding) for (rec, chunk, speaker, active) with any active frame: array of boolean.

    Every item is embedded on its own, without padding, so that results don't hang on what shares a batch.
    """
    from pyspark.sql import functions as F

    both = windows.select("rec", F.col("chunk_idx").alias("chunk"), "samples").join(masks.where(F.exists("active", lambda x: x)), ["rec", "chunk"])

    def run(batches):
        for b in batches:
            out = [backend.embed(S.fbank(S.speaker_samples(np.asarray(s, np.float32), np.asarray(a, bool)))).astype(float) for s, a in zip(b["samples"], b["active"], strict=True)]
            yield pd.DataFrame({"rec": b["rec"], "chunk": b["chunk"], "speaker": b["speaker"], "embedding": out})

    return both.select("rec", "chunk", "speaker", "samples", "active").mapInPandas(run, f"rec {dict(windows.dtypes)['rec']}, chunk int, speaker int, embedding array<double>")
