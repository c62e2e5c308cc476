"""Inputs the queries share. Nothing is kept between queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methmix import bridge, labels
from methmix.operators import atlas, design, intervals, relational, scoring
from methmix.plans import pipelines
from methmix.session import materialize
from methmix.sources.tables import pool_counts

SOURCE = "blueprint_loyfer2022"
SHARE = 0.25  # reads per mixture, as a share of all pool rows
POOL_TO_REF = dict(zip(bridge.GROUPS, bridge.CELL_TYPES))
SUBSET_TO_REF = dict(zip(bridge.SUBSET_POOLS, bridge.SUBSET_TYPES))
# The shares of the other T subsets while one is titrated.
SUBSET_SHARES = {"t_effector": labels.T_REG_SHARES_UNDER_EFFECTOR, "t_reg": labels.T_EFFECTOR_SHARES_UNDER_REG}
KEYS = ["titrated", "proportion_id", "replicate"]


def region_reads(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_join(bridge.reads(spark, d), bridge.regions(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_regions(region_reads(spark, d), ["sample_id"])


def region_map(spark: SparkSession, d: str, table=None) -> DataFrame:
    return atlas.region_labels(atlas.panel_regions(bridge.panel(spark, d)), table or labels.REGION_LABELS_T_COMBINED)


def sample_map(spark: SparkSession, d: str, table=None, groups=None) -> DataFrame:
    return atlas.sample_labels(bridge.samples(spark, d), table or labels.SAMPLE_LABELS_T_COMBINED, SOURCE, groups)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return atlas.atlas_long(scores(spark, d), sample_map(spark, d), region_map(spark, d))


def atlas_matrix(spark: SparkSession, d: str) -> DataFrame:
    return atlas.atlas_wide(scores(spark, d), sample_map(spark, d), region_map(spark, d), bridge.CELL_TYPES)


def atlas_cells(spark: SparkSession, d: str) -> DataFrame:
    """Long form of the complete rows, stored: cells are often compared with sums of them."""
    return relational.long(stored_atlas(spark, d), "region_id", bridge.CELL_TYPES, "ref_celltype", "score")


def pool_map(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.pool_map(bridge.samples(spark, d), SOURCE, labels.T_COMBINED_GROUPS)


def pools(spark: SparkSession, d: str) -> DataFrame:
    """Pool rows with their call strings."""
    return pipelines.build_pools(bridge.reads(spark, d), bridge.regions(spark, d), pool_map(spark, d))


def scored_pools(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.scored_pools(pools(spark, d))


def abundance(counts: DataFrame) -> DataFrame:
    """Whole-blood abundance of the pools that exist."""
    table = {k: str(v) for k, v in labels.WHOLE_BLOOD_ABUNDANCE.items()}
    return counts.withColumn("abundance", relational.label_column("cell_type", table).cast("double"))


def whole_blood(counts: DataFrame, titrated: list[str] | None = None) -> DataFrame:
    return design.complete(design.custom_background(abundance(counts), titrated or bridge.GROUPS, labels.TITRATION_LEVELS))


def subset_trees(spark: SparkSession) -> DataFrame:
    """Whole blood with the T group divided into subsets, one tree for each titrated subset."""
    rows = []
    for titrated, shares in SUBSET_SHARES.items():
        rows += [(titrated, node, None, share) for node, share in labels.WHOLE_BLOOD_ABUNDANCE.items()]
        rows += [(titrated, node, "Blueprint-T", share) for node, share in {**shares, titrated: 0.0}.items()]
    return spark.createDataFrame(rows, "titrated string, node string, parent string, share double")


def subset_design(spark: SparkSession) -> DataFrame:
    return design.complete(design.tree_background(subset_trees(spark), labels.TITRATION_LEVELS))


def truth(design_table: DataFrame, pool_to_ref: dict[str, str] = POOL_TO_REF) -> DataFrame:
    """True proportion per reference cell type."""
    return design_table.select(
        "titrated", "proportion_id", "titration",
        relational.label_column("cell_type", pool_to_ref).alias("ref_celltype"),
        F.col("proportion").alias("true_proportion"),
        (F.col("cell_type") == F.col("titrated")).cast("int").alias("is_titrated"))


@dataclass
class Experiment:
    """A titration: region scores of its mixtures, its design, its pools, and their reference cell types."""

    scores: DataFrame
    design: DataFrame
    pools: DataFrame
    pool_to_ref: dict[str, str] = field(default_factory=lambda: POOL_TO_REF)

    def truth(self) -> DataFrame:
        return truth(self.design, self.pool_to_ref)


def experiment(spark: SparkSession, d: str, titrated: list[str] | None = None,
               stored: bool = False) -> Experiment:
    """`stored` writes the mixture scores once, for queries that read them several times."""
    pool = scored_pools(spark, d)
    counts = materialize(pool_counts(pool), "pool-counts")
    plan = whole_blood(counts, titrated)
    replicated = design.replicate(plan, labels.REPLICATES, labels.SEED)
    table = pipelines.mixture_scores(pool, counts, replicated, SHARE, labels.SEED)
    return Experiment(materialize(table, "mixture-scores") if stored else table, plan, pool)


def stored_atlas(spark: SparkSession, d: str, pool: DataFrame | None = None) -> DataFrame:
    """The atlas as a stored table, from scored pools if there are any: they hold the reads of
    the reference samples."""
    table = scores(spark, d) if pool is None else scoring.sum_scores(pool, ["sample_id"])
    return materialize(atlas.atlas_wide(table, sample_map(spark, d), region_map(spark, d), bridge.CELL_TYPES), "atlas")


def subset_region_map(spark: SparkSession, d: str) -> DataFrame:
    return atlas.region_labels(atlas.panel_regions(bridge.panel(spark, d, subsets=True)), labels.REGION_LABELS_T_SUBSET)


def subset_atlas(spark: SparkSession, d: str, pool: DataFrame | None = None) -> DataFrame:
    """The atlas of seven cell types, from scored pools if there are any."""
    reads = bridge.reads(spark, d, subsets=True)
    table = pipelines.sample_scores(reads, bridge.regions(spark, d)) if pool is None else scoring.sum_scores(pool, ["sample_id"])
    named = atlas.sample_labels(bridge.samples(spark, d, subsets=True), labels.SAMPLE_LABELS_T_SUBSET, SOURCE, labels.T_SUBSET_CELL_TYPES)
    return atlas.atlas_wide(table, named, subset_region_map(spark, d), bridge.SUBSET_TYPES)


def subset_pools(spark: SparkSession, d: str) -> DataFrame:
    """The seven pools, scored."""
    names = pipelines.pool_map(bridge.samples(spark, d, subsets=True), SOURCE, cell_type_groups=labels.T_SUBSET_CELL_TYPES)
    return pipelines.scored_pools(pipelines.build_pools(bridge.reads(spark, d, subsets=True), bridge.regions(spark, d), names))


def subset_experiment(spark: SparkSession, d: str) -> Experiment:
    """Titrations of two T subsets inside the T group of whole blood."""
    pool = subset_pools(spark, d)
    counts = materialize(pool_counts(pool), "pool-counts")
    plan = subset_design(spark)
    table = pipelines.mixture_scores(pool, counts, design.replicate(plan, labels.REPLICATES, labels.SEED), SHARE, labels.SEED)
    return Experiment(table, plan, pool, SUBSET_TO_REF)
