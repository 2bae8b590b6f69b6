"""Live recordings: transcripts as they arrive, windowed activity, hysteresis with state per speaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import transcripts


def stream_segments(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Segments of transcript files as they land in a folder; refused documents are left out."""
    files = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(folder)
    return transcripts.segments_of(transcripts.parse_transcripts(files.select(F.col("_metadata.file_path").alias("rec"), "value")), strict=False)


def windowed_activity(scores: DataFrame, width: str = "10 seconds", step: str = "1 second", late: str = "1 minute", threshold: float = 0.5) -> DataFrame:
    """(rec, speaker, window, active_frames, frames) of a stream (rec, speaker, ts, score), by event time; ts may be NTZ."""
    timed = scores.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    on = F.nanvl(F.col("score").cast("double"), F.lit(0.0)) > threshold
    return timed.groupBy("rec", "speaker", F.window("ts", width, step)).agg(F.sum(on.cast("long")).alias("active_frames"), F.count("*").alias("frames"))


def live_hysteresis(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hysteresis over a stream (rec string, speaker int, frame long, score double), carried from batch to batch.

    State per (rec, speaker): the last frame seen and whether it was active. Frames at or behind it are late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, on = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).sort_values("frame").drop_duplicates("frame")
        rows = rows[rows["frame"] > last]
        out = []
        for score in rows["score"].fillna(0.0):
            on = True if score > threshold else False if score < threshold else on
            out.append(on)
        if len(rows):
            state.update((int(rows["frame"].iloc[-1]), bool(on)))
        yield pd.DataFrame({"rec": key[0], "speaker": key[1], "frame": rows["frame"], "active": out})

    return scores.groupBy("rec", "speaker").applyInPandasWithState(step, "rec string, speaker int, frame long, active boolean", "last long, active boolean", "append", GroupStateTimeout.NoTimeout)
