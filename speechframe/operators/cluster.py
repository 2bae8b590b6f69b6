"""Embeddings to global speakers: filters, normalisation, projection, pairwise distances, average linkage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import vectors as V
from . import windows as W


@dataclass(frozen=True)
class ClusterConfig:
    threshold: float = 0.6
    num: int | None = None
    least: int | None = None
    most: int | None = None
    lda_dims: int = 128


def usable_embeddings(embeddings: DataFrame, binarized: DataFrame | None = None, percent: int = 20) -> DataFrame:
    """embeddings (rec, chunk, speaker, embedding) without NaN, of pairs active enough, with row: their order."""
    out = embeddings.where(F.col("embedding").isNotNull() & ~V.has_nan(F.col("embedding")))
    if binarized is not None:
        out = out.join(W.enough_activity(W.activity(binarized), percent).select("rec", "chunk", "speaker"), ["rec", "chunk", "speaker"], "left_semi")
    return out.withColumn("row", F.row_number().over(Window.partitionBy("rec").orderBy("chunk", "speaker")) - 1)


def normalized(embeddings: DataFrame) -> DataFrame:
    return embeddings.withColumn("embedding", V.l2_normalized(F.col("embedding")))


def lda_projected(embeddings: DataFrame, mean, transform, dims: int = 128) -> DataFrame:
    """embeddings projected; the matrices go to the executors once per query, with the function."""
    mean, transform = np.asarray(mean, float), np.asarray(transform, float)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(S.lda(np.stack(x.to_numpy()), mean, transform, dims))) if len(x) else pd.Series([], dtype=object)

    return embeddings.withColumn("embedding", project("embedding"))


def cosine_pairs(embeddings: DataFrame) -> DataFrame:
    """(rec, i, j, distance) for i < j within a recording; an equi-join by recording, norms computed once per row."""
    rows = embeddings.select("rec", "row", F.col("embedding").cast("array<double>").alias("e")).withColumn("n", V.norm(F.col("e")))
    a, b = rows.select("rec", F.col("row").alias("i"), F.col("e").alias("x"), F.col("n").alias("nx")), rows.select("rec", F.col("row").alias("j"), F.col("e").alias("y"), F.col("n").alias("ny"))
    return a.join(b, "rec").where("i < j").select("rec", "i", "j", V.cosine_distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("distance"))


def closest_pair(pairs: DataFrame) -> DataFrame:
    """(rec, i, j, distance): the least distance of each recording, the first (i, j) of equals; a partial aggregate."""
    best = pairs.groupBy("rec").agg(F.min(F.struct("distance", "i", "j")).alias("m"))
    return best.select("rec", "m.i", "m.j", "m.distance")


def average_linkage(distances: np.ndarray, config: ClusterConfig) -> np.ndarray:
    """Cluster of each row, numbered by smallest member. Sums of the original distances are kept, so linkage is exact.

    Merges the closest pair of clusters, the first in row order of equals, until `num` are left, or else `least` (1)
    are left or the closest is beyond the threshold and there are no more than `most`.
    """
    n = len(distances)
    sums, size, root = np.array(distances, float), np.ones(n), np.arange(n)
    near = np.where(np.triu(np.ones((n, n), bool), 1), sums, np.inf)
    alive = n
    floor = config.num if config.num is not None else config.least if config.least is not None else 1
    while alive > max(floor, 1):
        i, j = divmod(int(np.argmin(near)), n)
        if not np.isfinite(near[i, j]):
            break
        if config.num is None and near[i, j] > config.threshold and not (config.most is not None and alive > config.most):
            break
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        root[root == j] = i
        near[j, :] = near[:, j] = np.inf
        alive -= 1
        k = np.flatnonzero(np.bincount(root, minlength=n))
        above, below = k[k > i], k[k < i]
        near[i, above] = sums[i, above] / (size[i] * size[above])
        near[below, i] = sums[i, below] / (size[i] * size[below])
    return np.unique(root, return_inverse=True)[1] if n else root


def cluster_speakers(embeddings: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """(rec, chunk, speaker, global_id) of usable embeddings. One group is one recording, whose pairs fit a worker."""
    config = config or ClusterConfig()
    kind = dict(embeddings.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chunk", "speaker"], kind="stable")
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        n = np.sqrt((x * x).sum(1))
        scale = np.outer(n, n)
        distances = np.where(scale < V.F32_EPSILON, 1.0, 1 - (x @ x.T) / np.maximum(scale, V.F32_EPSILON))
        np.fill_diagonal(distances, 0)
        return rows[["rec", "chunk", "speaker"]].assign(global_id=average_linkage(distances, config).astype("int32"))

    rows = embeddings.select("rec", "chunk", "speaker", "embedding")
    return rows.groupBy("rec").applyInPandas(run, f"rec {kind['rec']}, chunk {kind['chunk']}, speaker {kind['speaker']}, global_id int")


def speaker_counts(assignments: DataFrame) -> DataFrame:
    """(rec, num_speakers): the distinct clusters of each recording."""
    return assignments.groupBy("rec").agg((F.max("global_id") + 1).alias("num_speakers"), F.countDistinct("global_id").alias("distinct_ids"))
