import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from methmix.functions import solvers
from methmix.operators import estimate, matrix

TYPES = ["t0", "t1", "t2"]


def check_optimal(gram, rhs, x, tolerance=1e-8):
    gradient = gram @ x - rhs
    assert (x >= 0).all() and (gradient >= -tolerance).all() and (np.abs(x * gradient) <= tolerance).all()


def test_exact_system_with_repeated_rows():
    a = np.array([[1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [1, 1, 1, 0, 0], [1, 1, 1, 1, 0], [0, 1, 1, 0, 1]], float)
    b = a @ np.array([0.3, 0, 0.3, 0.2, 0.2])
    x = solvers.solve_nonnegative(a.T @ a, a.T @ b)
    assert (x >= 0).all() and np.abs(a @ x - b).max() < 1e-6


def test_nearly_collinear_columns():
    a = np.array([[1, 1 + 1e-5], [2, 2 - 1e-5]])
    b = a @ np.array([2.0, 1.0]) + 0.1
    x = solvers.solve_nonnegative(a.T @ a, a.T @ b)
    check_optimal(a.T @ a, a.T @ b, x, 1e-6)


def test_equal_columns():
    a = np.hstack([np.vstack([np.eye(3), np.zeros((2, 3))]), np.ones((5, 2))])
    b = a @ np.array([0.2, 0, 0, 0.4, 0.4]) + np.array([0.05, 0.01, 0.02, 0.02, 0.07])
    x, _ = solvers.huber_fit(a, b, 5.0, True, False)
    check_optimal(a.T @ a, a.T @ b, x, 1e-6)


def test_active_set_on_random_systems():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = rng.integers(1, 9)
        a = rng.normal(size=(rng.integers(2, 25), k))
        if rng.random() < 0.3 and k > 1:
            a[:, 0] = a[:, 1]
        gram, rhs = a.T @ a, a.T @ rng.normal(size=len(a))
        check_optimal(gram, rhs, solvers.solve_nonnegative(gram, rhs), 1e-6)


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(size=(30, 3)) + 2 * np.eye(3)[rng.integers(0, 3, 30)]
    truth = {0: [0.2, 0.3, 0.5], 1: [0.7, 0.0, 0.3]}
    atlas = spark.createDataFrame([(f"r{i}", *map(float, row)) for i, row in enumerate(a)],
                                  "region_id string, t0 double, t1 double, t2 double")
    rows, noisy = [], []
    for m, x in truth.items():
        b = a @ np.array(x)
        noise = rng.normal(scale=0.02, size=30)
        noise[3] += 1.5
        rows += [(m, f"r{i}", 50, float(v)) for i, v in enumerate(b)]
        noisy += [(m, f"r{i}", 50, float(v)) for i, v in enumerate(b + noise)]
    kind = "mixture int, region_id string, number_molecules int, frac_alpha_leq_25pct double"
    return atlas, spark.createDataFrame(rows, kind), spark.createDataFrame(noisy, kind), truth, a


def fitted(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["mixture"], {})[r["ref_celltype"]] = r["coeff"]
    return {m: [by[t] for t in TYPES] for m, by in out.items()}


def test_planted_proportions_come_back(system):
    atlas, exact, _, truth, _ = system
    fits = [estimate.nnls(exact, atlas, ["mixture"], TYPES), estimate.ols(exact, atlas, ["mixture"], TYPES),
            estimate.nonneg_huber(exact, atlas, ["mixture"], TYPES, 0.05),
            estimate.huber(exact, atlas, ["mixture"], TYPES, 1.35)]
    for fit in fits:
        for m, x in fitted(fit).items():
            assert np.allclose(x, truth[m], atol=1e-6)


def test_estimates_scale_with_the_scores(system):
    atlas, _, noisy, _, _ = system
    once = fitted(estimate.nnls(noisy, atlas, ["mixture"], TYPES))
    twice = fitted(estimate.nnls(noisy.withColumn("frac_alpha_leq_25pct", F.col("frac_alpha_leq_25pct") * 2), atlas, ["mixture"], TYPES))
    for m in once:
        assert np.allclose(np.array(once[m]) * 2, twice[m], atol=1e-9)


def test_huber_with_large_delta_is_least_squares(system):
    atlas, _, noisy, _, _ = system
    plain = fitted(estimate.nnls(noisy, atlas, ["mixture"], TYPES))
    huber = fitted(estimate.nonneg_huber(noisy, atlas, ["mixture"], TYPES, 10.0))
    for m in plain:
        assert np.allclose(plain[m], huber[m], atol=1e-8)


@pytest.mark.parametrize("joint", [False, True])
def test_rounds_over_the_cluster_equal_the_fit_in_a_group(system, joint):
    atlas, _, noisy, _, _ = system
    if joint:
        fit = lambda n: estimate.huber(noisy, atlas, ["mixture"], TYPES, 1.35, group_regions=n)
    else:
        fit = lambda n: estimate.nonneg_huber(noisy, atlas, ["mixture"], TYPES, 0.2, group_regions=n)
    inside, rounds = fitted(fit(1000)), fitted(fit(0))
    for m in inside:
        assert np.allclose(inside[m], rounds[m], atol=1e-6)


def test_huber_agrees_with_spark_ml(system):
    atlas, _, noisy, _, _ = system
    own = fitted(estimate.huber(noisy, atlas, ["mixture"], TYPES, 1.35))
    rows = estimate.aligned(noisy.where("mixture = 0"), atlas, TYPES, keys=["mixture"]) \
        .select(array_to_vector(F.array(*TYPES)).alias("features"), F.col("b").alias("label"))
    model = LinearRegression(loss="huber", epsilon=1.35, fitIntercept=False, standardization=False, maxIter=500, tol=1e-12).fit(rows)
    assert np.allclose(own[0], model.coefficients.toArray(), atol=1e-4)


def test_missing_regions(system, spark):
    """drop: a missing region leaves the fit; zero: it counts as a score of 0."""
    atlas, exact, _, truth, a = system
    partial = exact.where(~((F.col("mixture") == 0) & F.col("region_id").isin("r1", "r2")))
    assert np.allclose(fitted(estimate.nnls(partial, atlas, ["mixture"], TYPES))[0], truth[0], atol=1e-6)
    b = a @ np.array(truth[0])
    b[[1, 2]] = 0
    expected = solvers.solve_nonnegative(a.T @ a, a.T @ b)
    assert np.allclose(fitted(estimate.nnls(partial, atlas, ["mixture"], TYPES, missing="zero"))[0], expected, atol=1e-9)
    wide = fitted(estimate.nonneg_huber(partial, atlas, ["mixture"], TYPES, 100.0, missing="zero"))
    assert np.allclose(wide[0], expected, atol=1e-8)


def test_zero_filled_huber_with_and_without_the_grid(system):
    atlas, _, noisy, _, _ = system
    partial = noisy.where(~((F.col("mixture") == 0) & F.col("region_id").isin("r1", "r2")))
    fit = lambda n: fitted(estimate.huber(partial, atlas, ["mixture"], TYPES, 1.35, missing="zero", group_regions=n))
    inside, rounds = fit(1000), fit(0)
    for m in inside:
        assert np.allclose(inside[m], rounds[m], atol=1e-6)


def test_broken_atlas_and_scores_are_not_fitted_silently(system, spark):
    atlas, exact, _, truth, _ = system
    one = atlas.limit(1)
    for broken in (atlas.union(one), atlas.union(one.withColumn("region_id", F.lit("new")).withColumn("t0", F.lit(None).cast("double"))),
                   atlas.union(one.withColumn("region_id", F.lit("new")).withColumn("t1", F.lit(float("nan"))))):
        for fit in (estimate.nnls, estimate.ols, lambda *a: estimate.huber(*a, 1.35)):
            with pytest.raises(ValueError):
                fit(exact, broken, ["mixture"], TYPES)
    score = "frac_alpha_leq_25pct"
    holes = exact.withColumn(score, F.when(F.col("region_id") == "r1", float("nan")).when(F.col("region_id") == "r2", None).otherwise(F.col(score)))
    for fit in (estimate.nnls, lambda *a: estimate.huber(*a, 1.35)):
        for m, x in fitted(fit(holes, atlas, ["mixture"], TYPES)).items():
            assert np.allclose(x, truth[m], atol=1e-6)


def test_a_stopped_fit_shows_it(system, monkeypatch):
    atlas, exact, noisy, _, a = system
    done = estimate.nonneg_huber(noisy, atlas, ["mixture"], TYPES, 0.2).select("converged", "iterations").distinct().collect()
    assert all(r["converged"] and 1 < r["iterations"] < 1000 for r in done)
    assert solvers.fit_huber(a, a @ np.array([0.1, 0.2, 0.7]) + np.sin(np.arange(30)), 0.1, True, False, steps=1)[2:] == (1, False)
    rhs = a.T @ a @ np.array([0.3, 0.4, 0.3])
    assert solvers.fit_nonnegative(a.T @ a, rhs)[2] and not solvers.fit_nonnegative(a.T @ a, rhs, steps=1)[2]
    monkeypatch.setattr(solvers, "HUBER_STEPS", 1)
    stopped = estimate.nonneg_huber(noisy, atlas, ["mixture"], TYPES, 0.2, group_regions=0).select("converged", "iterations").distinct().collect()
    assert [(r["converged"], r["iterations"]) for r in stopped] == [(False, 1)]


def test_optimality_flags(system):
    atlas, _, noisy, _, _ = system
    equations = estimate.normal_equations(estimate.aligned(noisy, atlas, TYPES, keys=["mixture"]), ["mixture"], TYPES)
    good = estimate.optimality(estimate.nnls(noisy, atlas, ["mixture"], TYPES), equations, ["mixture"], TYPES)
    assert all(r["feasible"] == r["gradient_ok"] == r["complementary"] == 1 for r in good.collect())
    shifted = estimate.nnls(noisy, atlas, ["mixture"], TYPES).withColumn("coeff", F.col("coeff") + 0.1)
    bad = estimate.optimality(shifted, equations, ["mixture"], TYPES)
    assert all(r["complementary"] == 0 for r in bad.collect())


def test_singular_values(system):
    atlas, _, _, _, a = system
    values = [r["singular_value"] for r in matrix.singular_values(atlas, TYPES).orderBy("component").collect()]
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False))
    edges = matrix.condition(matrix.singular_values(atlas, TYPES)).first()
    assert edges["condition_number"] == pytest.approx(values[0] / values[-1])


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(size=(8, 6))
    rows = [(f"s{i}", f"r{j}", float(x[i, j])) for i in range(8) for j in range(6) if (i, j) != (2, 3)]
    x[2, 3] = 0.0
    scores = spark.createDataFrame(rows, "sample_id string, region_id string, frac_alpha_leq_25pct double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt *= np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    expected = z @ vt[:3].T
    got = {r["sample_id"]: [r["PC1"], r["PC2"], r["PC3"]] for r in matrix.pca_scores(scores, 3).collect()}
    for i in range(8):
        assert np.allclose(got[f"s{i}"], expected[i], atol=1e-8)
    shares = [r["share"] for r in matrix.explained_variance(scores, 3).orderBy("component").collect()]
    assert np.allclose(shares, (s ** 2 / (s ** 2).sum())[:3])
    table = {(r["sample_id"], r["region_id"]): r["z"] for r in matrix.standardized(scores).collect()}
    assert table[("s0", "r3")] == pytest.approx(z[0, 3])
