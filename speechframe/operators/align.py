"""Transcript segments to speaker turns, by the sequential nearest end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOUBLE_MAX

_FOLD = """aggregate(turns, named_struct('off', 0, 'out', cast(array() as array<struct<speaker:string,idx:int>>)),
  (a, d) -> case when a.off >= size(ends) then a else transform(array(array_position(
      transform(slice(ends, a.off + 1, size(ends)), e -> abs(e - d.end)),
      array_min(transform(slice(ends, a.off + 1, size(ends)), e -> abs(e - d.end))))),
    p -> named_struct('off', int(a.off + p), 'out', concat(a.out,
      transform(sequence(1, int(p)), k -> named_struct('speaker', d.speaker, 'idx', int(a.off + k))))))[0] end,
  a -> a.out)"""


def align(turns: DataFrame, segments: DataFrame, kernel: str = "fold") -> DataFrame:
    """(rec, seg_idx, speaker, text, start, end).

    Each turn (rec, start, end, speaker), in order, takes the segments up to the one whose end is nearest to its own
    among those left, the first of equals; a null end is as far as can be. Segments after the last turn's are dropped.
    kernel: 'fold' stays in SQL; 'pandas' is one pass over arrays, for recordings of thousands of segments.
    """
    theirs = turns.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start", "speaker", "end"))).alias("turns"))
    ours = segments.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("end", F.lit(DOUBLE_MAX)).alias("end"), F.col("end").alias("shown"), "start", "text"))).alias("segs"))
    both = theirs.join(ours, "rec").withColumn("ends", F.transform("segs", lambda s: s["end"]))
    if kernel == "fold":
        labelled = both.select("rec", "segs", F.explode(F.expr(_FOLD)).alias("x")).select("rec", F.col("x.speaker").alias("speaker"), F.expr("segs[x.idx - 1]").alias("s"))
        return labelled.select("rec", "s.seg_idx", "speaker", "s.text", "s.start", F.col("s.shown").alias("end"))

    def label(batches):
        for b in batches:
            rows = []
            for rec, stops, speakers, ends in zip(b["rec"], b["stops"], b["speakers"], b["ends"], strict=True):
                off, ends = 0, np.asarray(ends, float)
                for stop, speaker in zip(stops, speakers, strict=True):
                    if off >= len(ends):
                        break
                    p = int(np.argmin(np.abs(ends[off:] - stop))) + 1
                    rows += [(rec, off + k, speaker) for k in range(p)]
                    off += p
            yield pd.DataFrame(rows, columns=["rec", "at", "speaker"])

    who = both.select("rec", F.transform("turns", lambda t: t["end"]).alias("stops"), F.transform("turns", lambda t: t["speaker"]).alias("speakers"), "ends")
    marks = who.mapInPandas(label, f"rec {dict(both.dtypes)['rec']}, at int, speaker string")
    spread = both.select("rec", F.posexplode("segs").alias("at", "s"))
    return marks.join(spread, ["rec", "at"]).select("rec", "s.seg_idx", "speaker", "s.text", "s.start", F.col("s.shown").alias("end"))
