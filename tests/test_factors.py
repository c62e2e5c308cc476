"""Orthogonal factors against numpy on the whole matrix, and on atlases that normal equations cannot solve."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from methmix.functions import solvers
from methmix.operators import estimate, factors

TYPES = ["t0", "t1", "t2"]
ATLAS = "region_id string, t0 double, t1 double, t2 double"
SCORES = "mixture int, region_id string, number_molecules int, frac_alpha_leq_25pct double"
PLANTED = {0: [0.2, 0.3, 0.5], 1: [0.7, 0.0, 0.3], 2: [0.0, 1.0, 0.0]}


def best_nonnegative(a, b):
    """The best of all sets of free columns."""
    best, error = np.zeros(a.shape[1]), np.linalg.norm(b)
    for n in range(1, a.shape[1] + 1):
        for free in map(list, itertools.combinations(range(a.shape[1]), n)):
            x = np.zeros(a.shape[1])
            x[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (x >= 0).all() and np.linalg.norm(a @ x - b) < error:
                best, error = x, np.linalg.norm(a @ x - b)
    return best


def fitted(df):
    out = {}
    for r in df.collect():
        assert r["converged"]
        out.setdefault(r["mixture"], {})[r["ref_celltype"]] = r["coeff"]
    return {m: np.array([by[t] for t in TYPES]) for m, by in out.items()}


def frames(spark, a, scores, parts=7):
    atlas = spark.createDataFrame([(f"r{i}", *map(float, row)) for i, row in enumerate(a)], ATLAS)
    rows = [(m, f"r{i}", 50, float(v)) for m, b in scores.items() for i, v in enumerate(b) if not np.isnan(v)]
    return atlas, spark.createDataFrame(rows, SCORES).repartition(parts)


@pytest.fixture(scope="module")
def alike(spark):
    """Two columns that differ by 1e-9: a condition of over 1e9."""
    rng = np.random.default_rng(1)
    a = rng.uniform(size=(400, 3))
    a[:, 1] = a[:, 0] + 1e-9 * rng.normal(size=400)
    assert np.linalg.cond(a) > 1e9
    return a, *frames(spark, a, {m: a @ np.array(x) for m, x in PLANTED.items()})


@pytest.mark.parametrize("missing", ["drop", "zero"])
@pytest.mark.parametrize("nonnegative", [True, False])
def test_planted_shares_of_an_ill_conditioned_atlas(alike, nonnegative, missing):
    _, atlas, scores = alike
    found = fitted(factors.least_squares(scores, atlas, ["mixture"], TYPES, nonnegative, missing=missing))
    assert sorted(found) == sorted(PLANTED)
    for m, x in PLANTED.items():
        assert np.abs(found[m] - x).max() < 1e-6
    plain = fitted(estimate.ols(scores, atlas, ["mixture"], TYPES))
    assert max(np.abs(plain[m] - x).max() for m, x in PLANTED.items()) > 0.01  # what squaring the condition costs


def test_singular_values_of_an_ill_conditioned_atlas(alike):
    a, atlas, _ = alike
    got = [r["singular_value"] for r in factors.singular_values(atlas.repartition(5), TYPES).orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(a, compute_uv=False), rtol=1e-5)


@pytest.mark.parametrize("missing", ["drop", "zero"])
def test_noisy_and_missing_scores(spark, monkeypatch, missing):
    monkeypatch.setattr(factors, "ROWS_FOLDED", 16)
    rng = np.random.default_rng(2)
    a = rng.uniform(size=(60, 3))
    scores = {m: a @ rng.uniform(-0.5, 1, size=3) + rng.normal(scale=0.1, size=60) for m in range(12)}
    for m, b in scores.items():
        b[rng.random(60) < 0.3] = np.nan
        b[:1] = 0.5
    scores[12] = np.full(60, np.nan)
    scores[12][:2] = [0.3, 0.4]  # fewer regions than cell types
    atlas, table = frames(spark, a, scores)
    table = table.union(spark.createDataFrame([(0, "elsewhere", 50, 0.5), (0, "r3", 1, None)], SCORES))
    seen = np.any([~np.isnan(b) for b in scores.values()], axis=0)
    for nonnegative in (True, False):
        found = fitted(factors.least_squares(table, atlas, ["mixture"], TYPES, nonnegative, missing=missing))
        for m, b in scores.items():
            kept = seen if missing == "zero" else ~np.isnan(b)
            rows, values = a[kept], np.nan_to_num(b[kept])
            if nonnegative:
                gap = np.linalg.norm(rows @ found[m] - values) - np.linalg.norm(rows @ best_nonnegative(rows, values) - values)
                assert (found[m] >= 0).all() and gap < 1e-9
            else:
                assert np.allclose(found[m], np.linalg.lstsq(rows, values, rcond=None)[0], atol=1e-9)


def test_empty_tables_and_null_keys(spark):
    atlas, scores = frames(spark, np.eye(3), {0: np.array([0.1, 0.2, 0.7])})
    none = scores.where("false")
    for missing in ("drop", "zero"):
        assert factors.least_squares(none, atlas, ["mixture"], TYPES, missing=missing).collect() == []
        assert factors.least_squares(scores, atlas.where("false"), ["mixture"], TYPES, missing=missing).collect() == []
        unnamed = scores.withColumn("mixture", F.lit(None).cast("int"))
        found = fitted(factors.least_squares(scores.union(unnamed), atlas, ["mixture"], TYPES, missing=missing))
        assert sorted(found, key=str) == [0, None] and np.allclose(list(found.values()), [[0.1, 0.2, 0.7]] * 2)
    assert factors.singular_values(atlas.where("false"), TYPES).collect() == []
    with pytest.raises(ValueError):
        factors.least_squares(scores, atlas, ["mixture"], TYPES, missing="other")


@pytest.mark.parametrize("missing", ["drop", "zero"])
def test_an_atlas_of_zeros(spark, missing):
    atlas, scores = frames(spark, np.zeros((4, 3)), {0: np.full(4, 0.5)})
    assert fitted(factors.least_squares(scores, atlas, ["mixture"], TYPES, missing=missing))[0].tolist() == [0, 0, 0]


def test_stacked_factors():
    rng = np.random.default_rng(4)
    codes = np.concatenate([np.zeros(500, int), rng.integers(0, 9, 300), np.arange(9)])
    rows = rng.normal(size=(len(codes), 4))
    for code, r in enumerate(solvers.triangular_factors(codes, rows)):
        own = rows[codes == code]
        assert np.allclose(r.T @ r, own.T @ own) and np.allclose(r, np.triu(r))


def test_active_set_without_products():
    rng = np.random.default_rng(7)
    for _ in range(300):
        k = rng.integers(1, 7)
        a = rng.normal(size=(rng.integers(2, 25), k))
        if rng.random() < 0.3 and k > 1:
            a[:, 0] = a[:, 1]
        b = rng.normal(size=len(a))
        x, _, final = solvers.fit_nonnegative_factor(a, b)
        assert final and (x >= 0).all()
        assert np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ best_nonnegative(a, b) - b) + 1e-9
