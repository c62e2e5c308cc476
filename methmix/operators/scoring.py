"""Fragment scores: per read, then summed per region and any set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methmix.functions import patterns
from methmix.labels import KMERS, MIN_OBSERVED_CPG, RATES_GEQ, RATES_LEQ
from methmix.schema import alpha_columns, score_columns


def trim_reads(region_reads: DataFrame) -> DataFrame:
    """Adds `trimmed_pat`, the calls of the read inside its region."""
    return region_reads.withColumn("trimmed_pat", patterns.trim_to_region(
        F.col("pat_string"), F.col("cpg_index_min"), F.col("cpg_index_max"),
        F.col("region_cpg_index_min"), F.col("region_cpg_index_max")))


def count_kmers(trimmed: DataFrame, kmers=KMERS) -> DataFrame:
    """Adds `meth_k`, `unmeth_k`, `total_k` window counts for every k."""
    packed = trimmed.withColumn("_packed", patterns.pack_calls(F.col("trimmed_pat")))
    masked = packed.withColumns({
        "_meth": patterns.call_mask(F.col("_packed"), "C"),
        "_unmeth": patterns.call_mask(F.col("_packed"), "T"),
    })
    counts = {}
    for k in kmers:
        counts.update(patterns.kmer_counts(F.col("trimmed_pat"), F.col("_meth"), F.col("_unmeth"), k))
    return masked.withColumns(counts).drop("_packed", "_meth", "_unmeth")


def flag_alpha(counted: DataFrame, rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> DataFrame:
    """Adds `alpha`, the methylated share of observed calls, and a 0/1 flag per rate."""
    alpha = F.try_divide(F.col("meth_k1"), F.col("total_k1"))
    names = alpha_columns(rates_leq, rates_geq)
    tests = [F.col("alpha") <= r for r in rates_leq] + [F.col("alpha") >= r for r in rates_geq]
    return counted.withColumn("alpha", alpha).withColumns({
        name: F.when(test, 1).otherwise(0).cast("bigint") for name, test in zip(names, tests)})


def observed_reads(trimmed: DataFrame, min_observed: int = MIN_OBSERVED_CPG) -> DataFrame:
    """Reads with at least `min_observed` observed calls inside their region.

    The optimizer moves this test into the overlap join; asking for the overlap first keeps
    it from cutting strings for pairs that do not overlap.
    """
    if min_observed < 1:
        raise ValueError("min_observed must be at least 1")
    overlaps = ((F.col("cpg_index_min") <= F.col("region_cpg_index_max"))
                & (F.col("cpg_index_max") >= F.col("region_cpg_index_min")))
    enough = patterns.observed_calls(F.col("trimmed_pat")) >= min_observed
    return trimmed.where(F.when(overlaps, enough).otherwise(False))


def score_reads(region_reads: DataFrame, min_observed: int = MIN_OBSERVED_CPG, kmers=KMERS,
                rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> DataFrame:
    """Scores of every read that has enough observed calls; the call strings are dropped.

    A read scores the same in every mixture it is drawn into, so mixtures are sampled from
    scored reads and never touch a string again.
    """
    return score_trimmed(trimmed_reads(region_reads, min_observed), kmers, rates_leq, rates_geq)


def trimmed_reads(region_reads: DataFrame, min_observed: int = MIN_OBSERVED_CPG) -> DataFrame:
    """The first half of `score_reads`: reads with enough observed calls, of their strings only the calls inside the region."""
    return observed_reads(trim_reads(region_reads), min_observed).drop(
        "pat_string", "cpg_index_min", "cpg_index_max", "region_cpg_index_min", "region_cpg_index_max")


def score_trimmed(trimmed: DataFrame, kmers=KMERS, rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> DataFrame:
    """The second half of `score_reads`: counts and flags instead of the calls."""
    if 1 not in kmers:
        raise ValueError("k = 1 is needed for the methylation rate")
    return flag_alpha(count_kmers(trimmed, kmers), rates_leq, rates_geq).drop("trimmed_pat", "alpha")


def sum_scores(scored: DataFrame, keys: list[str], weighting: str = "molecules", kmers=KMERS,
               rates_leq=RATES_LEQ, rates_geq=RATES_GEQ, region: str = "region_id") -> DataFrame:
    """Region scores per `keys`.

    weighting="molecules" counts a read once per molecule it stands for; weighting="rows"
    counts it once, and still divides the rate flags by the number of molecules.
    Only sums are aggregated, so they are combined on the map side and one crowded region or
    sample sends one row per task through the shuffle.
    """
    return finished(plain_sums(scored, keys, weighting, kmers, rates_leq, rates_geq, region), rates_leq, rates_geq)


def plain_sums(scored: DataFrame, keys: list[str], weighting: str = "molecules", kmers=KMERS,
               rates_leq=RATES_LEQ, rates_geq=RATES_GEQ, region: str = "region_id") -> DataFrame:
    """The sums of `sum_scores`, rate flags not yet divided, so that sums of parts can be added up."""
    source, values = weighted(scored, weighting, kmers, rates_leq, rates_geq)
    return source.groupBy(*keys, region).agg(*[F.sum(v).alias(n) for n, v in values.items()])


def weighted(scored: DataFrame, weighting: str = "molecules", kmers=KMERS,
             rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> tuple[DataFrame, dict[str, Column]]:
    """The rows that count, and the values to sum."""
    if weighting not in ("molecules", "rows"):
        raise ValueError("weighting must be 'molecules' or 'rows'")
    molecules = F.col("number_molecules").cast("bigint")
    weight = molecules if weighting == "molecules" else F.lit(1).cast("bigint")
    source = scored.where(molecules > 0) if weighting == "molecules" else scored
    return source, {"number_molecules": molecules, **{n: F.col(n) * weight for n in score_columns(kmers, rates_leq, rates_geq)}}


def finished(totals: DataFrame, rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> DataFrame:
    """Rate flags as shares of the molecules."""
    return totals.withColumns({n: F.try_divide(F.col(n), F.col("number_molecules")) for n in alpha_columns(rates_leq, rates_geq)})


def score_regions(region_reads: DataFrame, keys: list[str], weighting: str = "molecules",
                  min_observed: int = MIN_OBSERVED_CPG, kmers=KMERS,
                  rates_leq=RATES_LEQ, rates_geq=RATES_GEQ) -> DataFrame:
    """Region scores straight from reads that carry their region."""
    scored = score_reads(region_reads, min_observed, kmers, rates_leq, rates_geq)
    return sum_scores(scored, keys, weighting, kmers, rates_leq, rates_geq)


def explode_molecules(reads: DataFrame) -> DataFrame:
    """One row per molecule, each counting as one; `copy_no` tells the copies apart. A read of
    no molecules disappears."""
    copies = F.array_repeat(F.lit(1), F.col("number_molecules").cast("int"))
    exploded = reads.select("*", F.posexplode(copies).alias("copy_no", "_one"))
    return exploded.drop("_one").withColumn("number_molecules", clamp_molecules(F.col("number_molecules")))


def clamp_molecules(n):
    """Two or more molecules become one."""
    return F.when(n >= 2, 1).otherwise(n)
