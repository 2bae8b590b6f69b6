"""Subtitles and transcript documents from segments (rec, seg_idx, text, start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FORMATS = ("srt", "vtt", "txt")
HEADERS = {"srt": "", "vtt": "WEBVTT\n\n", "txt": ""}
TRANSCRIPT = "speakers array<struct<speaker:string,text:string,timestamp:array<double>>>, chunks array<struct<text:string,timestamp:array<double>>>, text string"


def cues(segments: DataFrame, fmt: str) -> DataFrame:
    """(rec, seg_idx, cue_no, cue): one cue or line per segment, numbered from 1 in order."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    number = F.row_number().over(Window.partitionBy("rec").orderBy("seg_idx"))
    clock = T.srt_timestamp if fmt == "srt" else T.vtt_timestamp
    text = T.unicode_trim(F.col("text"))
    times = F.concat(clock(F.col("start")), F.lit(" --> "), clock(T.end_or_start(F.col("start"), F.col("end"))))
    cue = F.concat(text, F.lit("\n")) if fmt == "txt" else F.concat(F.col("cue_no").cast("string"), F.lit("\n"), times, F.lit("\n"), text, F.lit("\n\n"))
    return segments.withColumn("cue_no", number).select("rec", "seg_idx", "cue_no", cue.alias("cue"))


def _ordered(order: str, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("x")))), lambda s: s["x"])


def documents(segments: DataFrame, fmt: str) -> DataFrame:
    """(rec, document): the whole file of each recording."""
    return cues(segments, fmt).groupBy("rec").agg(F.concat(F.lit(HEADERS[fmt]), F.array_join(_ordered("seg_idx", "cue"), "")).alias("document"))


def full_text(segments: DataFrame) -> DataFrame:
    return segments.groupBy("rec").agg(F.array_join(_ordered("seg_idx", "text"), "").alias("text"))


def transcripts(segments: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """(rec, transcript): the document of each recording as a struct; speakers, if given: (rec, seg_idx, speaker, text, start, end)."""
    times = F.array("start", "end")
    out = segments.groupBy("rec").agg(_ordered("seg_idx", F.struct("text", times.alias("timestamp"))).alias("chunks"), F.array_join(_ordered("seg_idx", "text"), "").alias("text"))
    empty = F.array().cast("array<struct<speaker:string,text:string,timestamp:array<double>>>")
    if speakers is None:
        out = out.withColumn("speakers", empty)
    else:
        theirs = speakers.groupBy("rec").agg(_ordered("seg_idx", F.struct("speaker", "text", times.alias("timestamp"))).alias("speakers"))
        out = out.join(theirs, "rec", "left").withColumn("speakers", F.coalesce("speakers", empty))
    return out.select("rec", F.struct("speakers", "chunks", "text").alias("transcript"))
