"""Mixtures drawn from read pools.

All mixtures of an experiment come out of one pass over the pools, and the work follows the rows drawn.

Dense mixtures, that take more than SPARSE of a pool: a pool row meets each of its cell type and is kept where its draw is
below the threshold of the mixture. Where only sums of the drawn rows are asked for, tasks draw blocks of rows into blocks of mixtures
as arrays (`functions.dense_draws`).

Sparse ones are drawn by a Poisson process. Those of one experiment (titrated type) and cell type lie end to end as intervals, each
-ln(1 - fraction) long, cut into cells of about half a unit. A row places a Poisson number of points in a cell; most rows place
none, and one comparison tells. A point belongs to the mixture in whose interval it falls, and
a row is drawn if it has a point there, which has just the probability `fraction`.

A draw is a pure function of the row key and of the mixture's key and seed, of a sparse one those of its cell (see
`functions.hashing`): the same on any partitioning, after lost tasks, and beside any other experiments.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from methmix.functions import dense_draws as blocks
from methmix.functions import hashing
from methmix.operators import scoring
from methmix.session import broadcast_if_small, fits_broadcast, materialize

ROWS_PER_SALT = 200_000  # rows of a pool in one piece, when the mixture table is too large to broadcast
MIXTURE_KEYS = ["titrated", "proportion_id", "replicate"]
# A dense mixture compares at most 1 / SPARSE rows for one that it draws; summing that one costs about as much.
SPARSE = 1 / 256
UNIT = 1 << 45  # lengths of intervals are whole multiples of 1 / UNIT
CELL = UNIT // 2  # a cell ends with the interval that reaches so far
# Points that a row may place in a cell: more are rarer than one step of the draw, as a cell is at most
# 0.5 - ln(1 - SPARSE) long.
POINTS = 11
BIN_BITS = 25  # of a point's 31; a cell has 64 bins, in which its points look for their interval


def sampling_fractions(design: DataFrame, pool_counts: DataFrame, total_reads: DataFrame) -> DataFrame:
    """Adds `pool_rows` and `fraction` = proportion * total / pool size.

    `total_reads` has a `total_reads` column and either key columns of the design, with one
    row for each of their values, or one row in all; anything else is an error.
    """
    sized = design.join(pool_counts, "cell_type")
    shared = [c for c in total_reads.columns if c != "total_reads"]
    if shared:
        unknown = [c for c in shared if c not in design.columns]
        if unknown:
            raise ValueError(f"total_reads has columns {unknown} that the design lacks")
        repeated = total_reads.groupBy(*shared).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise ValueError("total_reads has more than one row for a key")
        sized = sized.join(total_reads, shared)
    else:
        if len(total_reads.take(2)) != 1:
            raise ValueError("total_reads without key columns must have exactly one row")
        sized = sized.crossJoin(F.broadcast(total_reads))
    return sized.withColumn("fraction", F.col("proportion") * F.col("total_reads") / F.col("pool_rows"))


def copy_thresholds(fractions: DataFrame) -> DataFrame:
    """Adds `copy_no` and `threshold`: a row is drawn for the n-th time if its draw, as a
    share of one, is below the n-th threshold.

    A fraction up to 1 draws without replacement: one threshold, the fraction. Above 1 a row
    is drawn Poisson(fraction) times: threshold n is the probability of n or more copies.
    Passes of Poisson(1) and one of the remainder add up to the same distribution. Thresholds
    end where they fall below one step of the draw, as no draw tells them from 0.
    """
    rate = F.col("fraction")
    spread = F.when(rate > 1, F.ceil(rate + 12 * F.sqrt(rate) + 12)).otherwise(F.lit(1)).cast("int")
    counted = fractions.where(rate > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), spread)))
    row = Window.partitionBy(*[c for c in MIXTURE_KEYS if c in fractions.columns], "cell_type").orderBy("copy_no")
    before = F.col("copy_no") - 1
    log_factorial = F.sum(F.when(before > 0, F.ln(before)).otherwise(0.0)).over(row)
    logged = counted.withColumn("_log_factorial", log_factorial)
    mass = F.exp(before * F.ln(rate) - rate - F.col("_log_factorial"))
    at_least = logged.withColumn("_below", F.sum(mass).over(row))
    # P(X >= n) = 1 - P(X <= n-1); `_below` runs over masses of 0 .. n-1.
    tail = F.greatest(1 - F.col("_below"), F.lit(0.0))
    return (at_least.withColumn("threshold", F.when(rate > 1, tail).otherwise(rate))
            .where((F.col("copy_no") == 1) | (F.col("threshold") >= 1 / hashing.PRIME)).drop("_log_factorial", "_below"))


def keyed_pools(pools: DataFrame, row_key: list[str]) -> DataFrame:
    """Pools with the words of the row key; `row_key` must tell rows apart (add `copy_no` if
    molecules were exploded)."""
    digested = pools.withColumn("_digest", hashing.digest(*[F.col(c) for c in row_key]))
    return digested.withColumns(hashing.row_words(F.col("_digest"))).drop("_digest")


def region_numbers(pools: DataFrame) -> DataFrame:
    """The regions of the pools with a 64-bit number each; two regions with one number raise an error."""
    regions = materialize(pools.select("region_id").distinct().withColumn("region_no", F.xxhash64("region_id")), "regions")
    every, numbers = regions.agg(F.count(F.lit(1)), F.count_distinct("region_no")).first()
    if every != numbers:
        raise ValueError("two regions have the same number")
    return regions


def with_seeds(fractions: DataFrame, seed: int) -> DataFrame:
    """`fractions` with a `seed` for each mixture: its own if the design has one, or else one
    derived from `seed` and the mixture's key."""
    if "seed" in fractions.columns:
        return fractions
    return fractions.withColumn("seed", hashing.derived_seed(F.lit(seed), F.concat_ws("-", *[F.col(k).cast("string") for k in MIXTURE_KEYS])))


@dataclass
class MixturePlan:
    """The mixtures as stored tables of draws, which grow with the design alone: `names` (numbers and keys of the mixtures), `dense` (one
    row per mixture, cell type and copy), `cells` and the `intervals` in them (sparse mixtures)."""

    names: DataFrame
    dense: DataFrame | None
    cells: DataFrame | None
    intervals: DataFrame | None


def mixture_plan(fractions: DataFrame, seed: int) -> MixturePlan:
    """Mixtures get a number from their key, so that the large sums compare integers, not names."""
    kept = with_seeds(fractions, seed).where(F.col("fraction") > 0).select(*MIXTURE_KEYS, "seed", "cell_type", "fraction")
    kept = materialize(kept.withColumn("mixture_no", F.xxhash64(*MIXTURE_KEYS)), "mixtures")
    names = kept.select(*MIXTURE_KEYS, "seed", "mixture_no").distinct()
    every, numbers, dense, sparse = kept.agg(
        F.count_distinct(*MIXTURE_KEYS), F.count_distinct("mixture_no"),
        F.count(F.when(F.col("fraction") > SPARSE, 1)), F.count(F.when(F.col("fraction") <= SPARSE, 1))).first()
    if every != numbers:
        raise ValueError("two mixtures have the same number")
    plan = MixturePlan(names, None, None, None)
    if dense:
        plan.dense = materialize(dense_draws(kept.where(F.col("fraction") > SPARSE)), "dense-draws")
    if sparse:
        placed = materialize(sparse_intervals(kept.where(F.col("fraction") <= SPARSE)), "sparse-intervals")
        plan.cells, plan.intervals = materialize(sparse_cells(placed), "sparse-cells"), binned_intervals(placed)
    return plan


def only_mixtures(plan: MixturePlan, keys: DataFrame) -> MixturePlan:
    """The part of a plan that draws the mixtures of `keys`. They are drawn as in the whole plan, whose cells they keep."""
    names = materialize(plan.names.join(keys.select(*MIXTURE_KEYS).distinct(), MIXTURE_KEYS, "left_semi"), "mixture-names")

    def own(table: DataFrame | None, of: DataFrame, by: str) -> DataFrame | None:
        return None if table is None else materialize(table.join(of.select(by).distinct(), by, "left_semi").select(*table.columns), "own-draws")

    intervals = own(plan.intervals, names, "mixture_no")
    return MixturePlan(names, own(plan.dense, names, "mixture_no"),
                       None if intervals is None else own(plan.cells, intervals, "cell_no"), intervals)


def dense_draws(mixtures: DataFrame) -> DataFrame:
    """One row per mixture, cell type and copy, with the words of the mixture key and its limit."""
    key = hashing.digest(F.col("seed"), *[F.col(k) for k in MIXTURE_KEYS], F.col("cell_type"))
    return copy_thresholds(mixtures).withColumn("_key", key).withColumns({
        **hashing.mixture_words(F.col("_key")), "limit": F.col("threshold") * F.lit(float(hashing.PRIME)),
    }).select("cell_type", "mixture_no", "copy_no", "mix_a", "mix_b", "mix_c", "limit")


def sparse_intervals(mixtures: DataFrame) -> DataFrame:
    """The interval of every mixture, `lo` up to before `hi` of the steps of a draw, in its `cell_no`; `rate` is the cell's length,
    `cell_key` names the cell and the seeds in it. Windows run over the mixtures of one experiment."""
    line = Window.partitionBy("titrated", "cell_type")
    inside = Window.partitionBy("titrated", "cell_type", "_cell")
    order = ["replicate", "proportion_id"]
    ordered = inside.orderBy(*order)
    length = F.round(-F.ln(1 - F.col("fraction")) * UNIT).cast("bigint")
    placed = mixtures.withColumn("_length", length).where("_length > 0").withColumn(
        "_cell", F.floor((F.sum("_length").over(line.orderBy(*order)) - F.col("_length")) / CELL))
    steps, total = F.lit(float(hashing.PRIME)), F.sum("_length").over(inside)
    end = F.sum("_length").over(ordered)
    seeds = F.sort_array(F.collect_list(F.struct(*order, "seed")).over(inside))
    return placed.select(
        "cell_type", "mixture_no",
        F.floor((end - F.col("_length")) / total * steps).alias("lo"), F.floor(end / total * steps).alias("hi"),
        (total / F.lit(float(UNIT))).alias("rate"), F.concat_ws(
            "|", F.array_join(F.transform(seeds, lambda s: s["seed"].cast("string")), ","), "titrated", "cell_type",
            F.col("_cell").cast("string")).alias("cell_key")).withColumn("cell_no", F.xxhash64("cell_key"))


def sparse_cells(placed: DataFrame) -> DataFrame:
    """One row per cell: the words of its number of points and of their places, and the limits of 1 to POINTS points."""
    cells = placed.select("cell_type", "cell_no", "cell_key", "rate").distinct()
    every, numbers = cells.agg(F.count_distinct("cell_key"), F.count_distinct("cell_no")).first()
    if every != numbers:
        raise ValueError("two cells have the same number")
    # 1 + r (1 + r/2 (1 + r/3 ...)), the Poisson masses up to n - 1 points, times e^r.
    limits = {}
    for n in range(1, POINTS + 1):
        masses = "1D"
        for k in range(n - 1, 0, -1):
            masses = f"(1D + rate / {k}D * {masses})"
        limits[f"limit_{n}"] = F.expr(f"(1D - exp(-rate) * {masses}) * {hashing.PRIME}D")
    words = {**hashing.mixture_words(F.md5("cell_key")), **hashing.place_words(F.md5("cell_key"), F.md5(F.concat("cell_key", F.lit("|points"))))}
    return cells.withColumns({**words, **limits}).drop("cell_key", "rate")


def binned_intervals(placed: DataFrame) -> DataFrame:
    """The intervals once for each bin of their cell that they reach into."""
    bins = F.explode(F.sequence(F.shiftright("lo", BIN_BITS), F.shiftright(F.greatest(F.col("hi") - 1, F.col("lo")), BIN_BITS)))
    return placed.select("cell_no", "mixture_no", "lo", "hi", bins.alias("bin"))


def _meet(pools: DataFrame, draws: DataFrame) -> DataFrame:
    """Every pool row with the rows of `draws` of its cell type."""
    if fits_broadcast(draws):
        return pools.join(F.broadcast(draws), "cell_type")
    # A pool is split into as many pieces as its size asks for, and its mixtures go to each.
    pieces = materialize(pools.groupBy("cell_type").agg(
        F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("bigint").alias("_pieces")), "pool-pieces")
    pieces = F.broadcast(pieces)  # one row per cell type of the design
    own = pools.join(pieces, "cell_type").withColumn("_salt", F.col("row_x") % F.col("_pieces")).drop("_pieces")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1))
    return own.join(draws.join(pieces, "cell_type").withColumn("_salt", copies).drop("_pieces"),
                    ["cell_type", "_salt"]).drop("_salt")


def _points(pools: DataFrame, plan: MixturePlan) -> DataFrame:
    """Rows drawn into sparse mixtures: `pools` with `mixture_no` and `copy_no`."""
    limits = [f"limit_{n}" for n in range(1, POINTS + 1)]
    met = _meet(pools, plan.cells).where(hashing.draw() < F.col("limit_1"))
    number = sum((hashing.draw() < F.col(c)).cast("int") for c in limits[1:]) + F.lit(1)
    placed = met.withColumns({"_n": number, **hashing.places()}).drop("row_x", "row_y", *limits, *hashing.WORDS)
    points = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).withColumn("_at", hashing.place(F.col("_i")))
    points = points.withColumn("bin", F.shiftright("_at", BIN_BITS))
    hits = points.join(broadcast_if_small(plan.intervals), ["cell_no", "bin"]).where((F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi")))

    def inside(i: Column) -> Column:
        return (hashing.place(i) >= F.col("lo")) & (hashing.place(i) < F.col("hi"))
    # A row that has several points in an interval is drawn for the first.
    first = (F.col("_i") == 1) | ~F.exists(F.sequence(F.lit(1), F.greatest(F.col("_i") - 1, F.lit(1))), inside)
    return hits.where(first).drop("cell_no", "bin", "lo", "hi", "_n", "_i", "_at", *hashing.PLACES).withColumn("copy_no", F.lit(1))


def _draws(pools: DataFrame, plan: MixturePlan) -> list[DataFrame]:
    """Drawn pool rows with `mixture_no` and `copy_no`, which replaces a column of this name: those of dense and of sparse mixtures."""
    parts, pools = [], pools.drop("copy_no")
    if plan.dense is not None:
        met = _meet(pools, plan.dense).where(hashing.draw() < F.col("limit"))
        parts.append(met.drop("row_x", "row_y", "mix_a", "mix_b", "mix_c", "limit"))
    if plan.cells is not None:
        parts.append(_points(pools, plan))
    none = pools.limit(0).drop("row_x", "row_y").withColumns({"mixture_no": F.lit(0).cast("bigint"), "copy_no": F.lit(1)})
    return parts or [none]


def _dense_sums(pools: DataFrame, dense: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """The rows that `dense` draws of `pools`, summed by (`mixture_no`, `group`) in the tasks that draw them: `drawn`, `most_copies` and the
    sums of `values`, 64-bit integers. Sums of parts: a key may come out in several rows. `dense` has proven small and goes to the tasks once.
    """
    spark = pools.sparkSession
    shared = spark.sparkContext.broadcast(blocks.draws_by_type(dense.toArrow()))
    rows = pools.select("cell_type", "row_x", "row_y", F.col(group).alias("_group"), *[v.cast("bigint").alias(k) for k, v in values.items()])
    schema = T.StructType([T.StructField("mixture_no", T.LongType()), T.StructField(group, pools.schema[group].dataType)]
                          + [T.StructField(name, T.LongType()) for name in ("drawn", "most_copies", *values)])
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: blocks.summed_draws(batches, shared.value, arrow), schema)


def _summed(pools: DataFrame, plan: MixturePlan, group: str, values: dict[str, Column]) -> DataFrame:
    """The drawn rows of `_draws` summed by (`mixture_no`, `group`): `drawn`, `most_copies` and the sums of `values`, integer columns."""
    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("mixture_no", group).agg(F.count(F.lit(1)).alias("drawn"), F.max("copy_no").cast("bigint").alias("most_copies"),
                                                     *[F.sum(v.cast("bigint")).alias(k) for k, v in values.items()])

    if plan.dense is None or not fits_broadcast(plan.dense):
        parts = [sums(part) for part in _draws(pools, plan)]
    else:
        sparse = MixturePlan(plan.names, None, plan.cells, plan.intervals)
        parts = [_dense_sums(pools, plan.dense, group, values)]
        parts += [] if plan.cells is None else [sums(part) for part in _draws(pools, sparse)]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("mixture_no", group).agg(
        F.sum("drawn").alias("drawn"), F.max("most_copies").alias("most_copies"), *[F.sum(k).alias(k) for k in values])


def mix_totals(pools: DataFrame, fractions: DataFrame, seed: int, columns: list[str], row_key: list[str] | None = None) -> DataFrame:
    """What `mix` draws, by mixture and cell type: rows `drawn`, `most_copies` of one row, and the sums of integer `columns`. The rows are the
    same and are summed in the tasks that draw them, so that none is named, written or shuffled."""
    keyed = pools if "row_x" in pools.columns else keyed_pools(pools, row_key or ["molecule_id", "region_id"])
    plan = mixture_plan(fractions, seed)
    totals = _summed(keyed, plan, "cell_type", {c: F.col(c) for c in columns})
    return totals.join(broadcast_if_small(plan.names), "mixture_no").drop("mixture_no")


def mix(pools: DataFrame, fractions: DataFrame, seed: int, row_key: list[str] | None = None) -> DataFrame:
    """Drawn rows of every mixture, with the mixture keys, its `seed` and `copy_no`.

    `fractions` comes from `sampling_fractions` and carries `MIXTURE_KEYS`. The tables of draws are broadcast if proven small. Otherwise both
    sides are shuffled by (cell type, salt): a pool is split by its row key into pieces of about
    `ROWS_PER_SALT` rows and its mixtures are copied to each, as there are few cell types and
    one may hold most rows. Mixtures are drawn independently of each other.
    """
    keyed = pools if "row_x" in pools.columns else keyed_pools(pools, row_key or ["molecule_id", "region_id"])
    plan = mixture_plan(fractions, seed)
    drawn = reduce(DataFrame.unionByName, _draws(keyed, plan))
    return drawn.join(broadcast_if_small(plan.names), "mixture_no").drop("mixture_no")


def mix_scores(pools: DataFrame, fractions: DataFrame, seed: int, weighting: str = "molecules",
               only: DataFrame | None = None) -> DataFrame:
    """Region scores of every mixture of scored, keyed pools. No mixture is written or
    shuffled: each drawn row goes into the sums of its (mixture, region) in the same stage,
    under integer keys; the names are joined to the sums. `only` holds the keys of the mixtures to score, all by default."""
    plan, regions = mixture_plan(fractions, seed), region_numbers(pools)
    if only is not None:
        plan = only_mixtures(plan, only)
    rows = pools.withColumn("region_no", F.xxhash64("region_id")).drop("region_id")
    source, values = scoring.weighted(rows, weighting)
    sums = scoring.finished(_summed(source, plan, "region_no", values).drop("drawn", "most_copies"))
    return sums.join(plan.names, "mixture_no").drop("mixture_no").join(regions, "region_no").drop("region_no")


def realised_counts(mixture: DataFrame) -> DataFrame:
    """Rows actually drawn per mixture and cell type, with the mixture's seed, from the rows of `mix` or from `mix_totals`."""
    if "drawn" in mixture.columns:
        return mixture.select(*MIXTURE_KEYS, "seed", "cell_type", "drawn")
    return mixture.groupBy(*MIXTURE_KEYS, "seed", "cell_type").agg(F.count(F.lit(1)).alias("drawn"))


def mix_native(pools: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """One mixture with Spark's own sampler: without replacement up to a fraction of 1, with
    replacement above. Depends on partitioning; `mix` does not."""
    parts = []
    for i, (cell_type, fraction) in enumerate(sorted(fractions.items())):
        pool = pools.where(F.col("cell_type") == cell_type)
        parts.append(pool.sample(fraction > 1, float(fraction), seed + i))
    return reduce(DataFrame.unionByName, parts)


def total_as_share(pools_counts: DataFrame, share: Column | float) -> DataFrame:
    """One-row `total_reads` table: a share of all pool rows, rounded down."""
    return pools_counts.agg(F.floor(F.sum("pool_rows") * share).cast("bigint").alias("total_reads"))
