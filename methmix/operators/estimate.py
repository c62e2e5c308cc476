"""Proportion estimates from region scores and an atlas.

Least squares needs only the Gram matrix of the atlas rows and their products with the scores.
Spark sums those per mixture in one aggregation; what is left per mixture is a system with one
unknown per cell type. Huber fits repeat that aggregation with weights, or, while a mixture
has a proven small number of regions, iterate inside the mixture's group.

Estimates are long tables: the mixture keys, `ref_celltype`, `coeff`, `iterations`, `converged` and
`method`. A fit that hit the limit of its steps has converged = false. Scores that are null or NaN are
missing scores. An atlas must have one complete row per region; anything else is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methmix.functions import solvers
from methmix.labels import MIN_MOLECULES_ESTIMATE, SCORE_COLUMN
from methmix.session import materialize, scratch_path

GROUP_REGIONS = 100_000  # atlas rows up to which a Huber fit may run inside one group
TINY = 1e-10             # a non-negative Huber coefficient below this is zero


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


# ---- aligning scores with the atlas -----------------------------------------
def checked_atlas(atlas: DataFrame, cell_types: list[str]) -> DataFrame:
    """The atlas as a stored table, once it is known to have one complete row per region."""
    stored = materialize(atlas.select("region_id", *[F.col(c).cast("double").alias(c) for c in cell_types]), "atlas")
    bad = F.lit(False)
    for c in ["region_id", *cell_types]:
        bad = bad | F.col(c).isNull() | (F.isnan(c) if c != "region_id" else F.lit(False))
    rows, regions, broken = stored.agg(F.count(F.lit(1)), F.count_distinct("region_id"), F.count_if(bad)).first()
    if broken or rows != regions:
        raise ValueError(f"atlas: {rows - regions} repeated regions, {broken} incomplete rows")
    return stored


def present_scores(scores: DataFrame, score: str, min_molecules: int | None, keys: list[str]) -> DataFrame:
    """Keys, `region_id` and `b` of the scores there are."""
    kept = scores if min_molecules is None else scores.where(F.col("number_molecules") >= min_molecules)
    return kept.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*keys, "region_id", F.col(score).cast("double").alias("b"))


def aligned(scores: DataFrame, atlas: DataFrame, cell_types: list[str], score: str = SCORE_COLUMN,
            min_molecules: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Keys, `region_id`, `b` and the atlas row, for the regions both sides have."""
    return present_scores(scores, score, min_molecules, keys or []).join(atlas.select("region_id", *cell_types), "region_id")


def zero_filled(present: DataFrame, atlas: DataFrame, keys: list[str]) -> DataFrame:
    """`present` with every atlas region any mixture has, b = 0 where a mixture lacks it: mixtures
    times regions by their definition. Only Huber fits beyond `GROUP_REGIONS` need these rows."""
    regions = atlas.select("region_id").join(present.select("region_id").distinct(), "region_id", "left_semi")
    grid = present.select(*keys).distinct().crossJoin(regions)
    return grid.join(present, keys + ["region_id"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))


# ---- normal equations -------------------------------------------------------
def gram_sums(cell_types: list[str], weight: Column | None = None) -> list[Column]:
    """Upper triangle of A'WA as `g_i_j` and A'Wb as `h_i`."""
    w = F.lit(1.0) if weight is None else weight
    k = range(len(cell_types))
    sums = [F.sum(F.col(cell_types[i]) * F.col(cell_types[j]) * w).alias(f"g_{i}_{j}")
            for i in k for j in k if i <= j]
    return sums + [F.sum(F.col(cell_types[i]) * F.col("b") * w).alias(f"h_{i}") for i in k]


def normal_equations(rows: DataFrame, keys: list[str], cell_types: list[str],
                     weight: Column | None = None) -> DataFrame:
    """One row per mixture: `n_regions`, `g_i_j`, `h_i` and `bb` = b'Wb."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_regions"), *gram_sums(cell_types, weight),
        F.sum(F.col("b") * F.col("b") * w).alias("bb"))


def zero_filled_equations(present: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str]) -> DataFrame:
    """Normal equations with 0 for the regions a mixture lacks, without writing those rows: a
    zero adds nothing to A'b, and A'A is the same for all mixtures, the sum over every atlas
    region any of them has."""
    rows = present.join(atlas, "region_id", "left")
    k = range(len(cell_types))
    own = rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.col(cell_types[i]) * F.col("b")), F.lit(0.0)).alias(f"h_{i}") for i in k],
        F.sum(F.when(F.col(cell_types[0]).isNotNull(), F.col("b") * F.col("b")).otherwise(0.0)).alias("bb"))
    grams = gram_sums(cell_types)[:len(cell_types) * (len(cell_types) + 1) // 2]
    shared = (atlas.join(present.select("region_id").distinct(), "region_id", "left_semi").withColumn("b", F.lit(0.0))
              .agg(F.count(F.lit(1)).alias("n_regions"), *grams))
    return own.crossJoin(F.broadcast(shared))  # one row by construction


def gram_long(rows: DataFrame, keys: list[str], cell_types: list[str]) -> DataFrame:
    """Gram entries as rows: (keys, row_celltype, col_celltype, value)."""
    k = range(len(cell_types))
    entries = F.array(*[
        F.struct(F.lit(cell_types[i]).alias("row_celltype"), F.lit(cell_types[j]).alias("col_celltype"),
                 F.col(f"g_{min(i, j)}_{max(i, j)}").alias("value")) for i in k for j in k])
    return normal_equations(rows, keys, cell_types).select(*keys, F.inline(entries))


def _systems(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The systems of a batch as stacks (n, k, k) and (n, k)."""
    grams = np.empty((len(frame), k, k))
    for i in range(k):
        for j in range(i, k):
            grams[:, i, j] = grams[:, j, i] = frame[f"g_{i}_{j}"].to_numpy(float)
    return grams, np.stack([frame[f"h_{i}"].to_numpy(float) for i in range(k)], axis=1)


def _free_fits(grams: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return solvers.solve_free_stack(grams, rhs), np.ones(len(rhs), int), np.ones(len(rhs), bool)


def _nonnegative_fits(grams: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the free solution of a regular system has no negative part it is the answer; the
    others go through the active-set method."""
    x, steps, final = _free_fits(grams, rhs)
    values = np.linalg.eigvalsh(grams)
    settled = (x >= 0).all(axis=1) & (values[:, 0] > 1e-10 * values[:, -1])
    for row in np.flatnonzero(~settled):
        x[row], steps[row], final[row] = solvers.fit_nonnegative(grams[row], rhs[row])
    return x, steps, final


def fit_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(_key_fields(df, keys) + [
        T.StructField("ref_celltype", T.StringType()), T.StructField("coeff", T.DoubleType()),
        T.StructField("iterations", T.IntegerType()), T.StructField("converged", T.BooleanType())])


def _solve(equations: DataFrame, keys: list[str], cell_types: list[str], method: str, solve) -> DataFrame:
    k = len(cell_types)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, steps, final = solve(*_systems(frame, k))
            out = frame[keys].loc[frame.index.repeat(k)].reset_index(drop=True)
            out["ref_celltype"] = cell_types * len(frame)
            out["coeff"], out["iterations"], out["converged"] = x.ravel(), np.repeat(steps, k), np.repeat(final, k)
            yield out

    return equations.mapInPandas(batches, fit_schema(equations, keys)).withColumn("method", F.lit(method))


# ---- estimators -------------------------------------------------------------
def naive(scores: DataFrame, regions: DataFrame, keys: list[str], score: str = SCORE_COLUMN,
          min_molecules: int = MIN_MOLECULES_ESTIMATE) -> DataFrame:
    """Mean score of the regions that target a cell type, over covered regions."""
    covered = scores.where(F.col("number_molecules") >= min_molecules)
    targeted = covered.join(regions.select("region_id", "ref_celltype"), "region_id")
    return targeted.groupBy(*keys, "ref_celltype").agg(F.avg(score).alias("coeff")).select(
        "*", F.lit(1).alias("iterations"), F.lit(True).alias("converged"), F.lit("naive").alias("method"))


def _equations(scores, atlas, cell_types, keys, score, min_molecules, missing) -> DataFrame:
    check_missing(missing)
    atlas = checked_atlas(atlas, cell_types)
    present = present_scores(scores, score, min_molecules, keys)
    if missing == "zero":
        return zero_filled_equations(materialize(present, "present"), atlas, keys, cell_types)
    return normal_equations(present.join(atlas, "region_id"), keys, cell_types)


def check_missing(missing: str) -> None:
    if missing not in ("drop", "zero"):
        raise ValueError("missing must be 'drop' or 'zero'")


def nnls(scores: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str],
         score: str = SCORE_COLUMN, min_molecules: int | None = None, missing: str = "drop") -> DataFrame:
    """Least squares with coefficients >= 0."""
    equations = _equations(scores, atlas, cell_types, keys, score, min_molecules, missing)
    return _solve(equations, keys, cell_types, "nnls", _nonnegative_fits)


def ols(scores: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str],
        score: str = SCORE_COLUMN, min_molecules: int | None = None, missing: str = "drop",
        clip: bool = False) -> DataFrame:
    """Unconstrained least squares; clip=True sets negative coefficients to 0 afterwards."""
    equations = _equations(scores, atlas, cell_types, keys, score, min_molecules, missing)
    fit = _solve(equations, keys, cell_types, "ols", _free_fits)
    if not clip:
        return fit
    return fit.withColumn("coeff", F.greatest("coeff", F.lit(0.0))).withColumn("method", F.lit("ols_clipped"))


def nonneg_huber(scores: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str],
                 delta: float, score: str = SCORE_COLUMN, min_molecules: int | None = None,
                 missing: str = "drop", nonnegative: bool = True, group_regions: int = GROUP_REGIONS) -> DataFrame:
    """Sum of Huber losses with a fixed `delta`; coefficients >= 0 unless nonnegative=False."""
    check_missing(missing)
    present = present_scores(scores, score, min_molecules, keys)
    fit = _huber(present, checked_atlas(atlas, cell_types), keys, cell_types, delta, nonnegative, False, missing, group_regions)
    small = F.abs("coeff") < TINY
    return fit.withColumn("coeff", F.when(small, 0.0).otherwise(F.col("coeff"))) \
        .withColumn("method", F.lit("nonneg_huber" if nonnegative else "huber_fixed"))


def huber(scores: DataFrame, atlas: DataFrame, keys: list[str], cell_types: list[str],
          epsilon: float = 1.35, force_zero: bool = False, score: str = SCORE_COLUMN,
          min_molecules: int | None = None, missing: str = "drop",
          group_regions: int = GROUP_REGIONS) -> DataFrame:
    """Huber regression with the scale estimated along, no intercept, no penalty.
    force_zero=True sets negative coefficients to 0 after the fit."""
    check_missing(missing)
    present = present_scores(scores, score, min_molecules, keys)
    fit = _huber(present, checked_atlas(atlas, cell_types), keys, cell_types, epsilon, False, True, missing, group_regions)
    if force_zero:
        fit = fit.withColumn("coeff", F.greatest("coeff", F.lit(0.0)))
    return fit.withColumn("method", F.lit("huber"))


def _huber(present, atlas, keys, cell_types, epsilon, nonnegative, joint_scale, missing, group_regions) -> DataFrame:
    """Reweighted least squares with one stop rule. While the atlas is small a mixture's steps
    run inside its group; beyond that each step is one aggregation over all mixtures."""
    if missing == "zero":
        present = materialize(present, "present")
    if atlas.limit(group_regions + 1).count() <= group_regions:
        return _huber_in_group(present, atlas, keys, cell_types, epsilon, nonnegative, joint_scale, missing == "zero")
    rows = zero_filled(present, atlas, keys) if missing == "zero" else present
    return _huber_by_rounds(rows.join(atlas, "region_id"), keys, cell_types, epsilon, nonnegative, joint_scale)


def _huber_in_group(present, atlas, keys, cell_types, epsilon, nonnegative, joint_scale, zero) -> DataFrame:
    """A group holds one mixture's scores, at most one per atlas row. The atlas, which has
    GROUP_REGIONS rows at most, goes to the tasks once; regions a mixture lacks need no rows."""
    used = atlas.join(present.select("region_id").distinct(), "region_id", "left_semi") if zero else atlas
    table = used.orderBy("region_id").toPandas()
    shared = present.sparkSession.sparkContext.broadcast(
        (dict(zip(table["region_id"], range(len(table)))), table[cell_types].to_numpy(float)))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        places, matrix = shared.value
        at = np.array([places.get(r, -1) for r in frame["region_id"]])
        a, b = matrix[at[at >= 0]], frame["b"].to_numpy(float)[at >= 0]
        if zero:
            a, filled = matrix, np.zeros(len(matrix))
            filled[at[at >= 0]] = b
            b = filled
        elif not len(b):
            return pd.DataFrame(columns=names)
        x, _, steps, final = solvers.fit_huber(a, b, epsilon, nonnegative, joint_scale)
        out = pd.DataFrame({"ref_celltype": cell_types, "coeff": x, "iterations": steps, "converged": final})
        for place, key in enumerate(keys):
            out.insert(place, key, frame[key].iloc[0])
        return out

    schema = fit_schema(present, keys)
    names = schema.fieldNames()
    return present.groupBy(*keys).applyInPandas(fit, schema)


def _huber_by_rounds(rows, keys, cell_types, epsilon, nonnegative, joint_scale) -> DataFrame:
    """The same steps for any number of regions: every round is one weighted aggregation over
    the mixtures that still move, written to the shared folder so that plans do not grow."""
    k = len(cell_types)
    solve = solvers.solve_nonnegative if nonnegative else solvers.solve_free
    state = [f"x_{i}" for i in range(k)]
    schema = T.StructType(_key_fields(rows, keys) + [T.StructField(s, T.DoubleType()) for s in state + ["sigma", "moved"]])
    spark = rows.sparkSession
    rows = materialize(rows.select(*keys, "b", *cell_types), "huber-rows")
    settled = scratch_path(spark, "huber-settled")

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([solve(g, h) for g, h in zip(*_systems(frame, k))]).reshape(len(frame), k)
            out = frame[keys].copy()
            out["moved"] = np.abs(x - frame[state].to_numpy(float)).max(axis=1, initial=0.0)
            out[state], out["sigma"] = x, frame["sigma"]
            yield out[keys + state + ["sigma", "moved"]]

    residual = F.col("b") - sum((F.col(c) * F.col(s) for c, s in zip(cell_types, state)), F.lit(0.0))
    start = normal_equations(rows, keys, cell_types).withColumns({s: F.lit(0.0) for s in state}) \
        .withColumn("sigma", F.lit(1.0))
    fits = materialize(start.mapInPandas(step, schema), "huber-state")
    if joint_scale:
        first = rows.join(fits.drop("sigma"), keys).withColumn("_r", residual)
        scales = first.groupBy(*keys).agg(F.greatest(F.stddev_pop("_r"), F.lit(1e-12)).alias("sigma"))
        fits = materialize(fits.drop("sigma").join(scales, keys).select(*schema.fieldNames()), "huber-state")
    for round_no in range(1, solvers.HUBER_STEPS + 1):
        placed = rows.join(fits.drop("moved"), keys).withColumn("_r", residual)
        if joint_scale:
            inside = F.abs("_r") <= epsilon * F.col("sigma")
            sums = placed.groupBy(*keys).agg(
                F.sum(F.when(inside, F.col("_r") ** 2).otherwise(0.0)).alias("_squares"),
                (F.count(F.lit(1)) - epsilon ** 2 * F.count_if(~inside)).alias("_left"))
            scale = F.when(F.col("_left") <= 0, 2 * F.col("sigma")).otherwise(
                F.greatest(F.sqrt(F.col("_squares") / F.greatest("_left", F.lit(1e-300))), F.lit(1e-12)))
            fits = materialize(fits.join(sums, keys).withColumn("sigma", scale).select(*schema.fieldNames()), "huber-scale")
            placed = rows.join(fits.drop("moved"), keys).withColumn("_r", residual)
        limit = epsilon * F.col("sigma")
        weight = F.when(F.abs("_r") > limit, limit / F.abs("_r")).otherwise(1.0)
        equations = normal_equations(placed.withColumn("_w", weight), keys, cell_types, F.col("_w"))
        fits = materialize(equations.join(fits.drop("moved"), keys).mapInPandas(step, schema), "huber-state")
        last = round_no == solvers.HUBER_STEPS
        rest = F.col("moved") < solvers.HUBER_TOLERANCE
        done = fits.where(rest | F.lit(last)).select("*", F.lit(round_no).alias("iterations"), rest.alias("converged"))
        done.write.mode("append").parquet(settled)
        fits = fits.where(~rest)
        if last or fits.isEmpty():
            break
    pairs = F.array(*[F.struct(F.lit(c).alias("ref_celltype"), F.col(s).alias("coeff"))
                      for c, s in zip(cell_types, state)])
    return spark.read.parquet(settled).select(*keys, F.inline(pairs), "iterations", "converged")


# ---- quality of a fit -------------------------------------------------------
def optimality(estimates: DataFrame, equations: DataFrame, keys: list[str], cell_types: list[str],
               tolerance: float = 1e-6) -> DataFrame:
    """Whether a non-negative fit is optimal: with gradient g = Gx - h, all x >= 0, all
    g >= 0 and all x*g = 0, up to a tolerance."""
    k = len(cell_types)
    wide = estimates.groupBy(*keys).agg(*[
        F.max(F.when(F.col("ref_celltype") == c, F.col("coeff"))).alias(f"x_{i}")
        for i, c in enumerate(cell_types)])
    joined = wide.join(equations, keys)
    gradient = [sum((F.col(f"g_{min(i, j)}_{max(i, j)}") * F.col(f"x_{j}") for j in range(k)), F.lit(0.0))
                - F.col(f"h_{i}") for i in range(k)]
    x = [F.col(f"x_{i}") for i in range(k)]
    return joined.select(
        *keys,
        (F.least(*x) >= 0).cast("int").alias("feasible"),
        (F.least(*gradient) >= -tolerance).cast("int").alias("gradient_ok"),
        (F.greatest(*[F.abs(a * g) for a, g in zip(x, gradient)]) <= tolerance).cast("int").alias("complementary"))


def squared_error(estimates: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean squared error of the coefficients against `true_proportion`."""
    joined = estimates.join(truth, keys)
    return joined.groupBy(*by).agg(
        F.avg(F.pow(F.col("coeff") - F.col("true_proportion"), F.lit(2))).alias("mse"))
