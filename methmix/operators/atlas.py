"""The reference atlas: mean region score per reference cell type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.labels import MIN_MOLECULES_ATLAS, SCORE_COLUMN
from methmix.operators import relational


def panel_regions(panel: DataFrame, version_flag: str = "v23_conv") -> DataFrame:
    """Panel entries of the current version, one row per (region, subpanel, target). A region
    may occur several times in the input because it spans several cut-site clusters."""
    return (panel.where(F.col(version_flag) == 1)
            .select("region_id", "subpanel", "target_celltype").dropDuplicates())


def region_labels(regions: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Bridge table region -> reference cell type, one row per pair."""
    return relational.relabel(regions.select("region_id", "target_celltype").distinct(),
                              "target_celltype", labels, "ref_celltype").select("region_id", "ref_celltype").distinct()


def sample_labels(samples: DataFrame, labels: dict[str, str], source: str | None = None,
                  cell_type_groups: dict[str, str] | None = None) -> DataFrame:
    """Bridge table sample -> reference cell type. `cell_type_groups` regroups samples by
    their detailed cell type before they are labelled."""
    chosen = samples.where(F.col("source") == source) if source else samples
    if cell_type_groups:
        chosen = chosen.withColumn("sample_group", relational.relabel_where(
            "cell_type", cell_type_groups, "sample_group"))
    return relational.relabel(chosen, "sample_group", labels, "ref_celltype") \
        .select("sample_id", "ref_celltype").distinct()


def _reference_scores(scores: DataFrame, samples: DataFrame, regions: DataFrame,
                      score: str, min_molecules: int) -> DataFrame:
    covered = scores.where(F.col("number_molecules") >= min_molecules) \
        .select("sample_id", "region_id", F.col(score).alias("score"))
    kept = relational.rows_with_key(covered, regions, "region_id")
    return kept.join(samples, "sample_id")


def atlas_long(scores: DataFrame, samples: DataFrame, regions: DataFrame,
               score: str = SCORE_COLUMN, min_molecules: int = MIN_MOLECULES_ATLAS) -> DataFrame:
    """Atlas cells (region_id, ref_celltype, score) from region scores per sample."""
    reference = _reference_scores(scores, samples, regions, score, min_molecules)
    return reference.groupBy("region_id", "ref_celltype").agg(F.avg("score").alias("score"))


def atlas_wide(scores: DataFrame, samples: DataFrame, regions: DataFrame, cell_types: list[str],
               score: str = SCORE_COLUMN, min_molecules: int = MIN_MOLECULES_ATLAS,
               complete: bool = True) -> DataFrame:
    """Atlas as a matrix with one column per reference cell type, in the given order.
    complete=True keeps regions that have a value for every cell type. One shuffle."""
    reference = _reference_scores(scores, samples, regions, score, min_molecules)
    matrix = relational.wide(reference, "region_id", "ref_celltype", "score", cell_types)
    return matrix.dropna(how="any", subset=cell_types) if complete else matrix


def ordered_atlas(atlas: DataFrame, regions: DataFrame, order: list[str]) -> DataFrame:
    """Atlas rows with the place of their target in a declared order, sorted by it. A region
    with several targets takes the first; the atlas keeps one row per region."""
    place = (regions.withColumn("place", relational.declared_order("ref_celltype", order))
             .groupBy("region_id").agg(F.min("place").alias("place")))
    return atlas.join(place, "region_id").orderBy("place", "region_id")


def outlier_flags(cells: DataFrame, fence: float = 1.5) -> DataFrame:
    """Atlas cells with the quartiles of their cell type and whether they lie outside
    `fence` interquartile ranges."""
    quartiles = cells.groupBy("ref_celltype").agg(
        F.percentile("score", 0.25).alias("q1"), F.percentile("score", 0.75).alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * fence
    outside = (F.col("score") < F.col("q1") - reach) | (F.col("score") > F.col("q3") + reach)
    return cells.join(quartiles, "ref_celltype") \
        .withColumn("is_outlier", outside.cast("int"))


def mean_variance(flagged: DataFrame) -> DataFrame:
    """Mean and sample variance per cell type, over all cells and without outliers."""
    inside = F.when(F.col("is_outlier") == 0, F.col("score"))
    return flagged.groupBy("ref_celltype").agg(
        F.avg("score").alias("mean_all"), F.var_samp("score").alias("variance_all"),
        F.avg(inside).alias("mean_inside"), F.var_samp(inside).alias("variance_inside"))


def specific_scores(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Atlas cells whose region targets their own cell type."""
    return cells.join(regions, ["region_id", "ref_celltype"], "left_semi")
