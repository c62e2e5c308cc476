"""Least squares and singular values by orthogonal factors, for atlases whose columns nearly depend on each other.

Normal equations square the condition of the atlas: from about 1e8 on they lose every digit. Here each task turns its
rows into triangular factors, and factors are merged pairwise up a tree, by Spark; the last one holds all a fit needs,
one unknown per cell type, and no product of the atlas with itself is taken. Estimates have the columns of
`estimate.nnls`. An atlas must have one complete row per region; scores that are null or NaN are missing.
Mixtures without a region that the atlas has give no rows, or with missing="zero" coefficients of 0. Where columns depend on each other exactly, free fits
return the shortest solution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.functions import solvers
from methmix.labels import SCORE_COLUMN
from methmix.operators import estimate
from methmix.session import materialize

ROWS_FOLDED = 200_000  # rows a task holds before it turns them into factors
PARTS = (1024, 32)     # tasks' factors are merged within so many parts, then within fewer


def triangular(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys and `factor`, the rows of a triangular R with R'R = M'M, M being the `columns` of the key's rows."""
    width = len(columns)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (rows.schema[k] for k in keys))

    def folded(frames: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        codes = (frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys
                 else np.zeros(len(frame), int))
        first = np.unique(codes, return_index=True)[1]
        sizes = np.minimum(np.bincount(codes), width)
        factors = solvers.triangular_factors(codes, frame[columns].to_numpy(float))
        out = frame[keys].iloc[first].reset_index(drop=True)
        out["_part"] = TaskContext.get().partitionId()
        out["factor"] = [f[:n].ravel() for f, n in zip(factors, sizes)]
        return out

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            if len(frame):
                held.append(frame)
                count += len(frame)
            if count >= ROWS_FOLDED:
                yield folded(held)
                held, count = [], 0
        if held:
            yield folded(held)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            stacks = [np.asarray(f, float).reshape(-1, width) for f in frame["factor"]]
            codes = np.repeat(np.arange(len(stacks)), [len(s) for s in stacks])
            frame["factor"] = [f.ravel() for f in solvers.triangular_factors(codes, np.concatenate(stacks))]
            yield frame

    out = rows.select(*keys, *columns).mapInPandas(fold, f"{fields}_part int, factor array<double>")
    gathered = F.flatten(F.collect_list("factor")).alias("factor")
    for parts in PARTS:
        grouped = out.groupBy(*keys, (F.col("_part") % parts).alias("_part")).agg(gathered)
        out = grouped.mapInPandas(merge, grouped.schema)
    last = out.groupBy(*keys).agg(gathered) if keys else out.agg(gathered).where(F.size("factor") > 0)
    return last.mapInPandas(merge, last.schema)


def singular_values(atlas: DataFrame, cell_types: list[str]) -> DataFrame:
    """Singular values of a complete atlas, largest first; the small ones are as exact as the large one's last digits
    allow, not their squares'."""
    k = len(cell_types)

    def decompose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for factor in frame["factor"]:
                values = np.linalg.svd(np.asarray(factor, float).reshape(-1, k), compute_uv=False)
                yield pd.DataFrame({"component": np.arange(1, k + 1), "singular_value": values})

    factor = triangular(estimate.checked_atlas(atlas, cell_types), [], cell_types)
    return factor.mapInPandas(decompose, "component int, singular_value double")


def least_squares(scores: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str], nonnegative: bool = True,
                  score: str = SCORE_COLUMN, min_molecules: int | None = None, missing: str = "drop") -> DataFrame:
    """`estimate.nnls` (or `estimate.ols`) by orthogonal factors. With missing="zero" all mixtures share the atlas: its
    rows are made orthonormal once, and each mixture needs sums of their products with its scores only."""
    estimate.check_missing(missing)
    stored = estimate.checked_atlas(atlas, cell_types)
    present = estimate.present_scores(scores, score, min_molecules, keys)
    k = len(cell_types)
    if missing == "drop":
        systems = triangular(present.join(stored, "region_id"), keys, [*cell_types, "b"])

        def unpack(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for factor in frame["factor"]:
                whole = np.asarray(factor, float).reshape(-1, k + 1)
                yield whole[:k, :k], whole[:k, k]
    else:
        systems, shared, back = _shared_systems(materialize(present, "present"), stored, keys, cell_types)

        def unpack(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for sums in frame[[f"h_{i}" for i in range(back.shape[1])]].to_numpy(float):
                yield shared, back @ sums

    solve = solvers.fit_nonnegative_factor if nonnegative else solvers.fit_free_factor

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = [solve(r, q) for r, q in unpack(frame)]
            out = frame[keys].loc[frame.index.repeat(k)].reset_index(drop=True)
            out["ref_celltype"] = cell_types * len(frame)
            out["coeff"] = np.concatenate([x for x, _, _ in fits]) if fits else np.empty(0)
            out["iterations"] = np.repeat(np.array([n for _, n, _ in fits], int), k)
            out["converged"] = np.repeat(np.array([f for _, _, f in fits], bool), k)
            yield out

    return systems.mapInPandas(fit, estimate.fit_schema(systems, keys)).withColumn(
        "method", F.lit("nnls_qr" if nonnegative else "ols_qr"))


def _shared_systems(present: DataFrame, atlas: DataFrame, keys: list[str],
                    cell_types: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """For mixtures with 0 for the regions they lack: per mixture `h_i`, products of its scores with the columns of
    Q1 = A V / s; then R and B with A = Q R for an orthonormal Q, and Q'b = B h. Q1 is orthonormal but for rounding, which a
    second factor of Q1 takes out. Only these factors, cell types squared, come to the driver."""
    k = len(cell_types)
    used = atlas.join(present.select("region_id").distinct(), "region_id", "left_semi")
    first = triangular(used, [], cell_types).first()
    _, values, turned = np.linalg.svd(np.asarray(first["factor"], float).reshape(-1, k) if first else np.zeros((1, k)))
    rank = int((values > k * np.finfo(float).eps * values.max(initial=0.0)).sum())
    columns = [f"q_{i}" for i in range(rank)]
    rows = used.select("region_id", *[
        sum((F.col(c) * float(v / values[i]) for c, v in zip(cell_types, turned[i])), F.lit(0.0)).alias(columns[i])
        for i in range(rank)])
    sums = [F.coalesce(F.sum(F.col(c) * F.col("b")), F.lit(0.0)).alias(f"h_{i}") for i, c in enumerate(columns)]
    # mixtures without a region of the atlas are all zeros there, and keep their rows
    systems = present.join(rows, "region_id", "left").groupBy(*keys).agg(*(sums or [F.count(F.lit(1)).alias("_rows")]))
    if not rank:
        return systems.where(F.lit(first is not None)), np.zeros((1, k)), np.zeros((1, 0))
    second = np.asarray(triangular(rows, [], columns).first()["factor"], float).reshape(-1, rank)
    return systems, second @ (values[:rank, None] * turned[:rank]), np.linalg.inv(second).T
