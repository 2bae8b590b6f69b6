"""Token streams as relations: greedy choice under suppression, and the cut into timed segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TokenSpec:
    """Fixed values of a vocabulary and its decoder."""

    end: int = 50257
    first_timestamp: int = 50365
    seconds_per_token: float = 0.02
    chunk_seconds: float = 30.0
    budget: int = 224


def timestamp_seconds(token: Column, spec: TokenSpec) -> Column:
    return (token - spec.first_timestamp) * spec.seconds_per_token


def prompt(start: int, task: int, language: int | None = None) -> list[int]:
    return [start, *([] if language is None else [language]), task]


def greedy_choice(logits: DataFrame, suppressed: DataFrame | None = None, keys=("rec", "chunk", "step")) -> DataFrame:
    """(keys, token): the first largest logit of (keys, token, logit) whose token isn't suppressed; 0 where none is left."""
    rows = logits.withColumn("x", F.when(F.isnan(F.col("logit").cast("double")), F.lit(None)).otherwise(F.col("logit")))
    if suppressed is not None:
        rows = rows.join(F.broadcast(suppressed.select("token").distinct().withColumn("off", F.lit(True))), "token", "left")
        rows = rows.withColumn("x", F.when(F.col("off").isNull(), F.col("x")))
    # The largest logit, then the smallest token: a partial aggregate, no sort.
    best = F.max(F.when(F.col("x").isNotNull(), F.struct("x", (-F.col("token")).alias("t"))))
    return rows.groupBy(*keys).agg(F.coalesce(-best["t"], F.lit(0)).cast("long").alias("token"))


def segments_of_tokens(tokens: DataFrame, spec: TokenSpec | None = None) -> DataFrame:
    """(rec, chunk, k, tokens, start, end): segments of (rec, chunk, pos, token), numbered within a chunk.

    A timestamp token closes the text before it and opens the next; the end token closes with a null end. Where the
    budget runs out first, pending text is dropped, unless there is no other segment: then it starts with the chunk.
    """
    spec = spec or TokenSpec()
    by = Window.partitionBy("rec", "chunk")
    upto = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("order", F.row_number().over(by.orderBy("pos")))
    rows = rows.withColumn("stop", F.min(F.when(F.col("token") == spec.end, F.col("order"))).over(by))
    rows = rows.withColumn("stop", F.when(F.col("stop") <= spec.budget, F.col("stop")))
    rows = rows.where((F.col("order") <= spec.budget) & (F.col("stop").isNull() | (F.col("order") < F.col("stop"))))
    stamp = F.col("token") >= spec.first_timestamp
    rows = rows.withColumn("g", F.sum(stamp.cast("int")).over(upto))
    parts = rows.groupBy("rec", "chunk", "g").agg(
        F.max(F.when(stamp, timestamp_seconds(F.col("token"), spec))).alias("at"),
        F.transform(F.array_sort(F.collect_list(F.when(~stamp, F.struct("pos", "token")))), lambda s: s["token"]).alias("tokens"),
        F.first(F.col("stop").isNotNull()).alias("ended"),
    )
    # Groups count up by one within a chunk, so the next row holds the closing timestamp.
    parts = parts.withColumn("close", F.lead("at").over(by.orderBy("g")))
    parts = parts.where(F.size("tokens") > 0).withColumn("many", F.count("*").over(by))
    offset = F.col("chunk") * spec.chunk_seconds
    parts = parts.where(F.col("close").isNotNull() | F.col("ended") | (F.col("many") == 1))
    lone = F.col("close").isNull() & ~F.col("ended")
    start = F.when(lone, offset).otherwise(F.coalesce("at", F.lit(0.0)) + offset)
    return parts.select("rec", "chunk", (F.row_number().over(by.orderBy("g")) - 1).cast("long").alias("k"), "tokens", start.alias("start"), (F.col("close") + offset).alias("end"))
