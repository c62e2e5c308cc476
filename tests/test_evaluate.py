import numpy as np
import pytest

from methmix.operators import evaluate


def lod(spark, curve, target=0.95):
    rates = spark.createDataFrame([("c", float(p), float(y)) for p, y in curve],
                                  "ref_celltype string, true_proportion double, rate double")
    row = evaluate.limit_of_detection(rates, ["ref_celltype"], target).first()
    return row["lod"], row["status"]


@pytest.mark.parametrize("curve, expected", [
    ([(0, 0), (0.1, 0.5), (0.2, 0.9), (0.3, 1.0)], (0.25, "ok")),
    ([(0, 0), (0.1, 0.5), (0.2, 0.9)], (None, "never_reached")),
    ([(0.01, 1.0), (0.1, 1.0)], (None, "below_grid")),
    ([(0, 0), (0.1, 0.95), (0.2, 1.0)], (0.1, "ok")),
    ([(0, 0), (0.1, 1.0), (0.2, 0.5), (0.3, 1.0)], (0.095, "ok")),  # not monotone: the first crossing
])
def test_limit_of_detection(spark, curve, expected):
    value, status = lod(spark, curve)
    assert status == expected[1]
    assert value == (None if expected[0] is None else pytest.approx(expected[0]))


def test_limit_equals_interpolation_inside_the_grid(spark):
    p, y = [0, 0.02, 0.05, 0.11, 0.2], [0, 0.15, 0.6, 0.97, 1.0]
    assert lod(spark, zip(p, y))[0] == pytest.approx(float(np.interp(0.95, y, p)))


@pytest.fixture(scope="module")
def estimates(spark):
    rows = [("c", 0.0, 0.03), ("c", 0.0, 0.0), ("c", 0.1, 0.07), ("c", 0.1, 0.13), ("c", 0.1, 0.02), ("c", 0.1, 0.131)]
    return spark.createDataFrame(rows, "ref_celltype string, true_proportion double, coeff double")


def test_detection_rate_and_zero_rule(estimates):
    rows = {r["true_proportion"]: r for r in evaluate.detection_rate(estimates, ["ref_celltype"], 0.02).collect()}
    assert (rows[0.0]["raw_rate"], rows[0.0]["rate"]) == (0.5, 0.0)
    assert rows[0.1]["rate"] == 0.75  # strictly above
    kept = evaluate.detection_rate(estimates, ["ref_celltype"], 0.02, zero_at_zero=False)
    assert {r["rate"] for r in kept.collect()} == {0.5, 0.75}


def test_rates_fall_with_the_threshold(estimates):
    at = lambda t: evaluate.detection_rate(estimates, ["ref_celltype"], t).where("true_proportion = 0.1").first()["rate"]
    assert at(0.0) >= at(0.05) >= at(0.1) >= at(0.2)


def test_tolerance_limits_are_included(estimates):
    rows = {r["true_proportion"]: r["rate"] for r in evaluate.tolerance_rate(estimates, ["ref_celltype"]).collect()}
    assert rows[0.1] == 0.5


def test_box_summary(estimates):
    row = evaluate.box_summary(estimates, ["true_proportion"]).where("true_proportion = 0.1").first()
    five = np.percentile([0.07, 0.13, 0.02, 0.131], [0, 25, 50, 75, 100])
    assert np.allclose([row[n] for n in ("min", "q1", "median", "q3", "max")], five)
