"""Detection rates, limit of detection, and summaries of estimates.

Input is the estimates table with the true proportion joined on; nothing is matched by
position. All of it aggregates over replicates first, so the windows see one row per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methmix.labels import LOD_TARGET, TOLERANCE


def with_truth(estimates: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates with `true_proportion`."""
    return estimates.join(truth, keys)


def _zero_rule(rate: Column, proportion: str, zero_at_zero: bool) -> Column:
    return F.when(F.col(proportion) == 0, 0.0).otherwise(rate) if zero_at_zero else rate


def detection_rate(estimates: DataFrame, keys: list[str], threshold: float,
                   proportion: str = "true_proportion", zero_at_zero: bool = True) -> DataFrame:
    """Share of replicates with an estimate above `threshold`. `raw_rate` keeps the share at
    proportion 0, where `rate` is 0 by rule."""
    raw = estimates.groupBy(*keys, proportion).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg((F.col("coeff") > threshold).cast("int")).alias("raw_rate"))
    return raw.withColumn("rate", _zero_rule(F.col("raw_rate"), proportion, zero_at_zero))


def tolerance_rate(estimates: DataFrame, keys: list[str], tolerance: float = TOLERANCE,
                   proportion: str = "true_proportion", zero_at_zero: bool = True) -> DataFrame:
    """Share of replicates within +-`tolerance` of the true proportion, limits included."""
    margin = F.col(proportion) * tolerance
    hit = F.col("coeff").between(F.col(proportion) - margin, F.col(proportion) + margin)
    raw = estimates.groupBy(*keys, proportion).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg(hit.cast("int")).alias("raw_rate"))
    return raw.withColumn("rate", _zero_rule(F.col("raw_rate"), proportion, zero_at_zero))


def limit_of_detection(rates: DataFrame, keys: list[str], target: float = LOD_TARGET,
                       proportion: str = "true_proportion") -> DataFrame:
    """Smallest proportion at which the rate reaches `target`, interpolated between levels.

    `status` is `ok`, `never_reached`, or `below_grid` if the rate at the smallest level is
    above the target already; `lod` is null unless it is `ok`.
    """
    level = Window.partitionBy(*keys).orderBy(proportion)
    p, y = F.col(proportion), F.col("rate")
    steps = rates.withColumns({
        "_next_p": F.lead(proportion).over(level), "_next_y": F.lead("rate").over(level),
        "_first": F.row_number().over(level) == 1})
    slope = (F.col("_next_p") - p) / (F.col("_next_y") - y)
    crossing = (F.when(y == target, p)
                .when((y <= target) & (F.col("_next_y") > target), p + (target - y) * slope))
    found = steps.groupBy(*keys).agg(
        F.min(crossing).alias("_lod"), F.max(F.when(F.col("_first"), y)).alias("_first_rate"))
    below = F.col("_first_rate") > target
    return found.select(
        *keys, F.when(~below, F.col("_lod")).alias("lod"),
        F.when(below, "below_grid").when(F.col("_lod").isNull(), "never_reached").otherwise("ok").alias("status"))


def lod_text(lod: DataFrame) -> DataFrame:
    """Adds the rounded limit: 5 places, and in percent with 3."""
    rounded = F.round("lod", 5)
    return lod.withColumns({"lod_rounded": rounded, "lod_percent": F.round(rounded * 100, 3)})


def box_summary(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, quartiles, maximum and count of the coefficients."""
    five = F.percentile("coeff", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ["min", "q1", "median", "q3", "max"]
    summed = estimates.groupBy(*keys).agg(five.alias("_five"), F.count("coeff").alias("n"))
    return summed.select(*keys, "n", *[F.get("_five", F.lit(i)).alias(n) for i, n in enumerate(names)])


def background_check(estimates: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Box summary, bias and mean squared error of every cell type against its truth; the
    titrated one has `is_titrated` = 1."""
    joined = with_truth(estimates, truth, keys)
    group = ["titrated", "true_proportion", "titration", "ref_celltype", "is_titrated"]
    gap = F.col("coeff") - F.col("true_proportion")
    errors = joined.groupBy(*group).agg(F.avg(gap).alias("bias"), F.avg(gap * gap).alias("mse"))
    return box_summary(joined, group).join(errors, group)


def paired_agreement(paired: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """How far two methods are from the identity line."""
    gap = F.col(f"coeff_{second}") - F.col(f"coeff_{first}")
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_difference"),
        F.max(F.abs(gap)).alias("max_difference"),
        F.avg((gap > 0).cast("int")).alias("share_above_line"))
