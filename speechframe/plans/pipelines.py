"""Transcription and diarization, end to end, as lazily composed DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, captions, cluster, decode, timeline, windows
from ..operators import backend as B
from ..options import PipelineOptions
from ..sources import audio, transcripts


def transcribe(samples: DataFrame, backend: B.Backend, options: PipelineOptions, chunk: int = 480_000) -> DataFrame:
    """(rec, seg_idx, text, start, end) from (rec, samples)."""
    chunks = windows.tumbling_chunks(samples, chunk)
    tokens = B.transcribe_chunks(chunks, backend, options.effective_task, options.spoken)
    return B.token_text(decode.segments_of_tokens(tokens), backend)


def diarize(samples: DataFrame, backend: B.Backend, options: PipelineOptions, sliding: windows.SlidingConfig | None = None, lda=None) -> DataFrame:
    """(rec, start, end, speaker): collapsed turns in seconds. A recording without samples is an error when the rows are made."""
    empty = F.raise_error(F.concat(F.lit("no audio to segment in "), F.col("rec").cast("string")))
    samples = samples.withColumn("samples", F.when(F.size("samples") > 0, F.col("samples")).otherwise(empty.cast(samples.schema["samples"].dataType)))
    s = sliding or windows.SlidingConfig()
    cut = windows.window_slices(samples, s.window, s.step)
    scores = windows.hysteresis(B.segment_windows(cut, backend))
    by = ["rec", "chunk", "speaker"]
    masks = scores.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "active"))), lambda x: x["active"]).alias("active"))
    found = cluster.normalized(cluster.usable_embeddings(B.embed_speakers(cut, masks, backend), scores))
    if lda is not None:
        found = cluster.lda_projected(found, *lda)
    ids = cluster.cluster_speakers(found, cluster.ClusterConfig(num=options.num_speakers, least=options.min_speakers, most=options.max_speakers))
    intervals = timeline.speaker_intervals(timeline.active_runs(scores), ids, s.step / s.sample_rate, s.window_s / backend.frames)
    return timeline.collapsed(timeline.coalesced(intervals)).drop("k")


def speaker_segments(turns: DataFrame, segments: DataFrame) -> DataFrame:
    return align.align(turns, segments)


def transcribe_files(spark: SparkSession, options: PipelineOptions, backend: B.Backend) -> None:
    """Reads options.file_name, a path or glob of audio, and writes a transcript document per recording."""
    samples = audio.read_audio(spark, options.file_name).select("rec", "samples")
    segments = transcribe(samples, backend, options)
    labelled = speaker_segments(diarize(samples, backend, options), segments) if options.diarize else None
    out = Path(options.transcript_path)
    transcripts.write_transcripts(captions.transcripts(segments, labelled), str(out.parent), out.name)
