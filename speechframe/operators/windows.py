"""Windows over sample positions and frames: tumbling, sliding, hysteresis, weighted overlap-add."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass(frozen=True)
class SlidingConfig:
    sample_rate: int = 16_000
    window_s: float = 10.0
    step_s: float = 1.0

    @property
    def window(self) -> int:
        return int(self.window_s * self.sample_rate)

    @property
    def step(self) -> int:
        return int(self.step_s * self.sample_rate)


def tumbling_chunks(samples: DataFrame, size: int = 480_000) -> DataFrame:
    """(rec, chunk_idx, start, samples): samples per recording as an array, cut and zero-padded. Empty: one zero chunk."""
    n = F.greatest(F.ceil(F.size("samples") / size), F.lit(1)).cast("int")
    spread = samples.select("rec", "samples", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
    start = F.col("chunk_idx") * size
    return spread.select("rec", "chunk_idx", start.cast("long").alias("start"), V.padded_slice(F.col("samples"), start, size).alias("samples"))


def chunk_positions(rows: DataFrame, size: int) -> DataFrame:
    """The same cut on long rows (rec, pos, v), without gathering a recording: (rec, chunk_idx, i, v), not padded."""
    return rows.select("rec", F.floor(F.col("pos") / size).cast("int").alias("chunk_idx"), (F.col("pos") % size).cast("int").alias("i"), "v")


def sliding_windows(lengths: DataFrame, window: int, step: int) -> DataFrame:
    """(rec, chunk_idx, start, length) from (rec, n): windows up to the first that reaches the end; none where n is 0."""
    last = F.greatest(F.ceil((F.col("n") - window) / step), F.lit(0)).cast("int")
    spread = lengths.where("n > 0").select("rec", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    start = F.col("chunk_idx").cast("long") * step
    return spread.select("rec", "chunk_idx", start.alias("start"), F.least(F.lit(window), F.col("n") - start).cast("int").alias("length"))


def window_slices(samples: DataFrame, window: int, step: int) -> DataFrame:
    """(rec, chunk_idx, start, samples): the zero-padded samples of each sliding window; samples as an array."""
    where = sliding_windows(samples.select("rec", F.size("samples").alias("n")), window, step).drop("length")
    return where.join(samples, "rec").select("rec", "chunk_idx", "start", V.padded_slice(F.col("samples"), F.col("start").cast("int"), window).alias("samples"))


def hysteresis(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores (rec, chunk, frame, speaker, score) with active: on above, off below, held at the threshold; NaN is 0."""
    score = F.nanvl(F.col("score").cast("double"), F.lit(0.0))
    edge = F.when(score > threshold, 1).when(score < threshold, 0)
    back = Window.partitionBy("rec", "chunk", "speaker").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("active", F.coalesce(F.last(edge, ignorenulls=True).over(back), F.lit(0)) == 1)


def threshold_binarize(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("active", F.nanvl(F.col("score").cast("double"), F.lit(0.0)) > threshold)


def activity(binarized: DataFrame) -> DataFrame:
    """(rec, chunk, speaker, active_frames, frames, ratio)."""
    counted = binarized.groupBy("rec", "chunk", "speaker").agg(F.sum(F.col("active").cast("long")).alias("active_frames"), F.count("*").alias("frames"))
    return counted.withColumn("ratio", F.col("active_frames") / F.col("frames"))


def enough_activity(counted: DataFrame, percent: int = 20) -> DataFrame:
    """Pairs active in at least `percent` of their frames, in whole numbers; the limit itself is enough."""
    return counted.where(F.col("active_frames") * 100 >= F.col("frames") * percent)


def overlap_add(scores: DataFrame, frames: int, step_frames: int, threshold: float | None = None, total_frames: Column | None = None) -> DataFrame:
    """(rec, frame, speaker, value): the Hamming-weighted mean of all windows over a frame; 0 where none weighs.

    One shuffle with partial sums. total_frames cuts the end; threshold adds active. NaN scores weigh nothing.
    """
    weight = V.hamming(F.col("frame"), frames)
    where = F.col("chunk") * step_frames + F.col("frame")
    kept = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))
    spread = scores.select("rec", "speaker", where.alias("at"), F.when(kept, weight).otherwise(0.0).alias("w"), F.when(kept, weight * F.col("score").cast("double")).otherwise(0.0).alias("x"))
    if total_frames is not None:
        spread = spread.where(F.col("at") < total_frames)
    out = spread.groupBy("rec", "at", "speaker").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    out = out.select("rec", F.col("at").alias("frame"), "speaker", F.when(F.col("w") > 1e-12, F.col("x") / F.col("w")).otherwise(0.0).alias("value"))
    return out if threshold is None else out.withColumn("active", F.col("value") > threshold)
