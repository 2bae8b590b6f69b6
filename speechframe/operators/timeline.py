"""Speaker timelines: active runs, coalesced intervals, collapsed turns. Windows are keyed by recording and below."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_runs(binarized: DataFrame) -> DataFrame:
    """(rec, chunk, speaker, first_frame, end_frame): maximal runs of active frames, the end exclusive."""
    order = Window.partitionBy("rec", "chunk", "speaker").orderBy("frame")
    on = binarized.where("active").withColumn("island", F.col("frame") - F.row_number().over(order))
    runs = on.groupBy("rec", "chunk", "speaker", "island").agg(F.min("frame").alias("first_frame"), (F.max("frame") + 1).alias("end_frame"))
    return runs.drop("island")


def speaker_intervals(runs: DataFrame, assignments: DataFrame, step, frame) -> DataFrame:
    """(rec, start, end, speaker): runs of (chunk, speaker) pairs that have a global id; pairs without one drop out.

    step, frame: of a window and a frame, in any one unit; whole units keep the comparison of touching ends exact.
    """
    joined = runs.join(assignments.select("rec", "chunk", "speaker", "global_id"), ["rec", "chunk", "speaker"])
    at = lambda c: F.col("chunk") * F.lit(step) + F.col(c) * F.lit(frame)
    return joined.select("rec", at("first_frame").alias("start"), at("end_frame").alias("end"), F.format_string("SPEAKER_%02d", F.col("global_id")).alias("speaker"))


def coalesced(intervals: DataFrame) -> DataFrame:
    """The union of each speaker's overlapping or touching intervals: (rec, start, end, speaker)."""
    by = Window.partitionBy("rec", "speaker").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("rec", "speaker", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("rec", "start", "end", "speaker")


def collapsed(intervals: DataFrame) -> DataFrame:
    """Turns: consecutive intervals of one speaker as one, which ends where the next turn starts.

    The last turn ends with the recording's last interval, whatever ended latest. Order: start, then speaker.
    """
    by = Window.partitionBy("rec").orderBy("start", "speaker", "end")
    whole = Window.partitionBy("rec").orderBy("start", "speaker", "end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = intervals.withColumn("fresh", F.lag("speaker").over(by).isNull() | (F.lag("speaker").over(by) != F.col("speaker"))).withColumn("final", F.last("end").over(whole))
    starts = marked.where("fresh")
    return starts.select("rec", "start", F.coalesce(F.lead("start").over(by), F.col("final")).alias("end"), "speaker", (F.row_number().over(by) - 1).cast("long").alias("k"))
