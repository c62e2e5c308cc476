"""The jobs of the library, read pools, reference scores and titration, as plans over its operators."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methmix.functions import hashing
from methmix.labels import SEED
from methmix.operators import intervals, mixing, relational, scoring
from methmix.session import broadcast_if_small, materialize

ROWS_PER_PIECE = 2_000_000  # rows of a pool in one file, at most
PIECES_PER_PARTITION = 4    # files for each shuffle partition, so that later tasks even out


def pool_map(samples: DataFrame, source: str | None = None, groups: dict[str, str] | None = None,
             cell_type_groups: dict[str, str] | None = None) -> DataFrame:
    """Bridge table sample -> pool (`cell_type`), sample groups merged as `groups` says; `cell_type_groups` first regroups samples
    by their detailed cell type."""
    chosen = samples.where(F.col("source") == source) if source else samples
    if cell_type_groups:
        chosen = chosen.withColumn("sample_group", relational.relabel_where("cell_type", cell_type_groups, "sample_group"))
    name = relational.override("sample_group", groups) if groups else F.col("sample_group")
    return chosen.select("sample_id", name.alias("cell_type")).distinct()


def build_pools(reads: DataFrame, regions: DataFrame, pools: DataFrame) -> DataFrame:
    """Reads of the regions, labelled with the pool of their sample. One plan: regions and
    samples are broadcast while small, the reads are not shuffled."""
    return intervals.overlap_join(reads, regions).join(broadcast_if_small(pools), "sample_id")


def sample_scores(reads: DataFrame, regions: DataFrame, weighting: str = "molecules") -> DataFrame:
    """Region scores of every reference sample."""
    return scoring.score_regions(intervals.overlap_join(reads, regions), ["sample_id"], weighting)


def scored_pools(pools: DataFrame, row_key: list[str] | None = None, weighting: str = "molecules") -> DataFrame:
    """Pools ready to be sampled: scores per read, the words of the row key, no strings.

    The raw reads are scanned a single time; the atlas, the pool sizes and the draws all read what is stored here. The trimmed
    rows are written once as they come, counted by (cell type, region), scored and dealt to pieces of about equal
    size by these counts. (Scores in one plan with the overlap join make a generated method too long for the JIT compiler.) A piece holds rows of one cell type and of few regions, so filters on the cell type skip its file
    and its sums per (mixture, region) fit in memory; neither a large pool nor a crowded region makes a large piece.
    """
    keyed = mixing.keyed_pools(pools, row_key or ["molecule_id", "region_id"])
    trimmed = materialize(scoring.trimmed_reads(keyed).drop("molecule_id", "chr"), "pool-rows")
    return materialize(dealt_by_counts(scoring.score_trimmed(trimmed)), "pools")


def dealt_by_counts(rows: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """`rows` (stored, with the words of the row key) dealt to partitions of one cell type each: four times the session's
    shuffle partitions, more where they would exceed `rows_per_piece`. Within one the rows lie region by region.

    The rows of a cell type are thought of as a line, region after region; a row's place in its region is its hash, as
    a share of the region's rows. The line is cut into equal lengths, so a region with more rows than a length is split by
    row key, and small ones share a piece. Windows run over counts of regions, never over rows.
    """
    spark = rows.sparkSession
    counts = materialize(rows.groupBy("cell_type", "region_id").agg(F.count(F.lit(1)).alias("_rows")), "region-counts")
    sizes = counts.groupBy("cell_type").agg(F.sum("_rows").alias("n")).orderBy("cell_type").collect()  # one row per cell type
    if not sizes:
        return rows
    wanted = PIECES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = min(rows_per_piece, math.ceil(sum(r["n"] for r in sizes) / wanted))
    lines, pieces = [], 0
    for r in sizes:
        own = math.ceil(r["n"] / length)
        lines.append((r["cell_type"], pieces, own, r["n"] / own))
        pieces += own
    lines = spark.createDataFrame(lines, T.StructType([
        rows.schema["cell_type"], T.StructField("_first", T.LongType()), T.StructField("_pieces", T.LongType()),
        T.StructField("_length", T.DoubleType())])).withColumnRenamed("cell_type", "_cell_type")
    before = F.sum("_rows").over(Window.partitionBy("cell_type").orderBy("region_id")) - F.col("_rows")
    starts = counts.withColumn("_start", before).join(F.broadcast(lines), F.expr("cell_type <=> _cell_type")) \
        .drop("cell_type").withColumnRenamed("region_id", "_region_id")
    met = rows.join(broadcast_if_small(starts), F.expr("cell_type <=> _cell_type AND region_id <=> _region_id"))
    place = F.col("_start") + F.col("row_x") / F.lit(float(hashing.WORD)) * F.col("_rows")
    piece = F.col("_first") + F.least(F.floor(place / F.col("_length")), F.col("_pieces") - 1)
    return met.withColumn("_piece", piece.cast("int")).repartitionById(pieces, F.col("_piece")) \
        .select(*rows.columns).sortWithinPartitions("region_id")


def mixture_scores(pools: DataFrame, counts: DataFrame, replicated: DataFrame, share: float,
                   seed: int = SEED, weighting: str = "molecules") -> DataFrame:
    """Region scores of every mixture of a design."""
    fractions = mixing.sampling_fractions(replicated, counts, mixing.total_as_share(counts, share))
    return mixing.mix_scores(pools, fractions, seed, weighting)


def continue_experiment(pools: DataFrame, counts: DataFrame, replicated: DataFrame, share: float, path: str,
                        seed: int = SEED, weighting: str = "molecules", steps: int = 4, most_steps: int | None = None) -> DataFrame:
    """`mixture_scores` kept under `path`, where a run that was stopped goes on: mixtures listed there as finished
    are not scored again. Returns all scores stored so far.

    A run scores the rest in up to `steps` passes over the pools (`most_steps` ends it earlier). Each writes a folder per mixture,
    replacing what a stopped pass may have left of it, and lists its mixtures afterwards. Draws follow
    the whole design, so a run in pieces gives the table of a run in one. Mixtures added to a design
    later are drawn by the larger one and the stored ones stay; where sparse mixtures share cells (see
    `operators.mixing`), a fresh run of the larger design may draw other rows for the old mixtures. Mixture keys are never null.
    """
    spark, keys = pools.sparkSession, mixing.MIXTURE_KEYS
    fractions = mixing.with_seeds(mixing.sampling_fractions(replicated, counts, mixing.total_as_share(counts, share)), seed)
    wanted = fractions.select(*keys).distinct()
    rest = materialize(wanted.join(_finished(spark, path, wanted.schema), keys, "left_anti")
                       .withColumn("_step", F.pmod(F.xxhash64(*keys), F.lit(steps))), "unfinished")
    todo = [r["_step"] for r in rest.select("_step").distinct().orderBy("_step").collect()]  # `steps` numbers at most
    for step in todo if most_steps is None else todo[:most_steps]:
        own = rest.where(F.col("_step") == step).drop("_step")
        scored = mixing.mix_scores(pools, fractions, seed, weighting, only=own)
        scored.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(*keys).parquet(f"{path}/scores")
        own.write.mode("append").parquet(f"{path}/finished")
    shape = mixing.mix_scores(pools.limit(0), fractions.limit(0), seed, weighting).schema
    try:
        return spark.read.schema(shape).parquet(f"{path}/scores").select(*shape.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def _finished(spark: SparkSession, path: str, keys: T.StructType) -> DataFrame:
    """Keys of the mixtures that are listed as finished."""
    try:
        return spark.read.schema(keys).parquet(f"{path}/finished")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], keys)
