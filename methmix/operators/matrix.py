"""Analysis of the atlas and of the sample-by-region matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.functions import solvers
from methmix.labels import SCORE_COLUMN
from methmix.session import materialize


def singular_values(atlas: DataFrame, cell_types: list[str]) -> DataFrame:
    """Singular values of a complete atlas with one row per region, largest first. Spark sums the k x k Gram matrix; the
    eigenvalues of that one row are taken in a task."""
    from methmix.operators.estimate import checked_atlas
    atlas = checked_atlas(atlas, cell_types)
    k = len(cell_types)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    gram = atlas.agg(*[F.sum(F.col(cell_types[i]) * F.col(cell_types[j])).alias(f"g_{i}_{j}") for i, j in pairs])

    def decompose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.dropna().to_dict("records"):  # the sums of an empty atlas are null
                g = np.empty((k, k))
                for i, j in pairs:
                    g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
                yield pd.DataFrame({"component": np.arange(1, k + 1), "singular_value": solvers.singular_values(g)})

    return gram.mapInPandas(decompose, "component int, singular_value double")


def condition(values: DataFrame) -> DataFrame:
    """Largest, smallest and ratio of the singular values."""
    edges = values.agg(F.max("singular_value").alias("largest"), F.min("singular_value").alias("smallest"))
    return edges.withColumn("condition_number", F.try_divide("largest", "smallest"))


def _stored(scores: DataFrame, score: str) -> DataFrame:
    """sample_id, region_id, value, read once; a missing score counts as 0."""
    value = F.when(F.isnan(score), 0.0).otherwise(F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
    return materialize(scores.select("sample_id", "region_id", value.alias("value")), "score-matrix")


def standardized(scores: DataFrame, score: str = SCORE_COLUMN) -> DataFrame:
    """Long (sample_id, region_id, z): per region mean 0 and population sd 1 over all samples,
    a missing score counting as 0. A constant region becomes 0. Only sums per region are
    taken, so samples a region lacks need not be written out for them."""
    cells = _stored(scores, score)
    n = cells.agg(F.count_distinct("sample_id").alias("n"))
    moments = cells.groupBy("region_id").agg(
        F.sum("value").alias("_sum"), F.sum(F.col("value") * F.col("value")).alias("_squares")).crossJoin(F.broadcast(n))
    mean = F.col("_sum") / F.col("n")
    variance = F.greatest(F.col("_squares") / F.col("n") - mean * mean, F.lit(0.0))
    limits = moments.select("region_id", mean.alias("_mean"), F.sqrt(variance).alias("_sd"))
    z = F.when(F.col("_sd") > 1e-12, (F.col("value") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return cells.join(limits, "region_id").select("sample_id", "region_id", z.alias("z"))


@dataclass
class Components:
    """Principal components of the standardised samples: the samples in order, their scores (a
    column per component, largest first) and the variance of every component."""

    samples: list[str]
    scores: np.ndarray
    variances: np.ndarray


def principal_components(scores: DataFrame, components: int, score: str = SCORE_COLUMN) -> Components:
    """PCA by the samples' products, which Spark sums over the regions: samples x samples numbers,
    whatever the number of regions. A region's row of samples is one task's smallest unit.

    The sign of a component is chosen so that its largest loading is positive.
    """
    cells = _stored(scores, score)
    samples = [r["sample_id"] for r in cells.select("sample_id").distinct().orderBy("sample_id").collect()]
    n = len(samples)
    place = {s: i for i, s in enumerate(samples)}
    regions = materialize(cells.groupBy("region_id").agg(
        F.collect_list("sample_id").alias("samples"), F.collect_list("value").alias("values")), "region-rows")

    def rows(frame: pd.DataFrame) -> np.ndarray:
        z = np.zeros((len(frame), n))
        for i, (names, values) in enumerate(zip(frame["samples"], frame["values"])):
            z[i, [place[s] for s in names]] = values
        z -= z.mean(axis=1, keepdims=True)
        sd = z.std(axis=1, keepdims=True)
        return np.where(sd > 1e-12, z / np.where(sd > 1e-12, sd, 1.0), 0.0)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for frame in frames:
            z = rows(frame)
            total += z.T @ z
        yield pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": total.ravel()})

    gram = np.zeros((n, n))
    for r in regions.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r["i"], r["j"]] = r["v"]
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.clip(values[::-1], 0.0, None), vectors[:, ::-1][:, :components]
    lengths = np.sqrt(values[:vectors.shape[1]])

    def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Loadings of largest size among a task's regions."""
        for frame in frames:
            loadings = rows(frame) @ vectors
            at = np.abs(loadings).argmax(axis=0)
            yield pd.DataFrame({"k": np.arange(loadings.shape[1]), "v": loadings[at, np.arange(loadings.shape[1])],
                                "region_id": frame["region_id"].to_numpy()[at]})

    best = regions.mapInPandas(largest, "k int, v double, region_id string").groupBy("k").agg(
        F.max_by("v", F.struct(F.round(F.abs("v"), 9), "region_id")).alias("v")).collect()
    signs = np.ones(vectors.shape[1])
    for r in best:
        signs[r["k"]] = -1.0 if r["v"] < 0 else 1.0
    return Components(samples, vectors * signs * lengths, values)


def pca_scores(scores: DataFrame, components: int = 4, score: str = SCORE_COLUMN) -> DataFrame:
    """Component scores per sample as `PC1` .., one row per sample."""
    found = principal_components(scores, components, score)
    names = [f"PC{i + 1}" for i in range(found.scores.shape[1])]
    schema = ", ".join(["sample_id string", *[f"{c} double" for c in names]])
    return scores.sparkSession.createDataFrame([(s, *map(float, row)) for s, row in zip(found.samples, found.scores)], schema)


def explained_variance(scores: DataFrame, components: int = 4, score: str = SCORE_COLUMN) -> DataFrame:
    """Share of the variance each component explains."""
    found = principal_components(scores, components, score)
    shares = found.variances / max(found.variances.sum(), 1e-300)
    return scores.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(shares[:components])], "component int, share double")
