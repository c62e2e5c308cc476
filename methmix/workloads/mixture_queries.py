"""Designs, sampling, mixture scores, estimates and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methmix import bridge, labels
from methmix.operators import design, estimate, evaluate, factors, intervals, mixing, relational, scoring
from methmix.operators.atlas import atlas_wide
from methmix.plans import pipelines
from methmix.session import materialize, scratch_path
from methmix.sources import tables
from methmix.sources.tables import pool_counts
from methmix.workloads import inputs
from methmix.workloads.base_sql import (FLAGS, OLS_SWEEPS, SEED_SQL, SUBSET_TABLES, TABLES, _map, compose, lod_from, mixture_words, rate_steps,
                                        rounded_scores, sparse_tables, sums, unpivoted)
from methmix.workloads.registry import as_bigint, query, rounded

TYPES = bridge.CELL_TYPES
KEYS = inputs.KEYS
EST_KEYS = "titrated, proportion_id::bigint as proportion_id, replicate, ref_celltype"
ID = ["proportion_id", "replicate"]


# ---- designs ----------------------------------------------------------------
def _sized(plan: DataFrame, counts: DataFrame) -> DataFrame:
    """A design with the pool sizes and sampling fractions it leads to."""
    fractions = mixing.sampling_fractions(plan, counts, mixing.total_as_share(counts, inputs.SHARE))
    return as_bigint(rounded(fractions, "proportion", "titration", "fraction", digits=7), "proportion_id")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Pool sizes, stored: the designs, fractions and size checks all read them."""
    observed = scoring.observed_reads(scoring.trim_reads(inputs.pools(spark, d)))
    return materialize(pool_counts(observed), "pool-counts")


def _sized_sql(source: str) -> str:
    return (f"select x.titrated, x.proportion_id::bigint as proportion_id, round(x.titration, 7) as titration, x.pool as cell_type, "
            f"round(x.proportion, 7) as proportion, c.pool_rows, t.total_reads, "
            f"round(x.proportion * t.total_reads / c.pool_rows, 7) as fraction "
            f"from {source} x join pool_counts c on c.pool = x.pool cross join total t")


UNIFORM = """select t.titrated, l.proportion_id, l.titration, a.pool, case when a.pool = t.titrated then l.titration
 else (1 - l.titration) / 4 end as proportion from abundance a cross join targets t cross join levels l"""


@query("design_uniform", compose(_sized_sql("uniform"), {"uniform": UNIFORM}))
def design_uniform(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return _sized(design.uniform_background(counts, bridge.GROUPS, labels.TITRATION_LEVELS), counts)


@query("design_custom", compose(_sized_sql("design")))
def design_custom(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return _sized(inputs.whole_blood(counts), counts)


# T and NK form the group, T is titrated inside it; group and rest add up to one.
GROUP_TOTAL = labels.T_GROUP_TOTAL + labels.WHOLE_BLOOD_ABUNDANCE["Blueprint-NK"]
TWO_LEVEL = f"""select 'Blueprint-T' as titrated, l.proportion_id, l.titration, a.pool,
 case when a.pool = 'Blueprint-T' then {GROUP_TOTAL!r}::double * l.titration
 when a.pool = 'Blueprint-NK' then {GROUP_TOTAL!r}::double * (1 - l.titration)
 else a.abundance end as proportion from abundance a cross join levels l"""


@query("design_two_level", compose(_sized_sql("two_level"), {"two_level": TWO_LEVEL}))
def design_two_level(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    grouped = inputs.abundance(counts).withColumn("in_group", F.col("cell_type").isin("Blueprint-T", "Blueprint-NK"))
    plan = design.two_level_background(grouped, ["Blueprint-T"], labels.TITRATION_LEVELS, GROUP_TOTAL)
    return _sized(design.complete(plan), counts)


@query("design_tree", compose(_sized_sql("design"), SUBSET_TABLES))
def design_tree(spark: SparkSession, d: str) -> DataFrame:
    """Two T subsets titrated inside the T group, whose other members share the rest, beside a background that stays."""
    counts = materialize(pool_counts(inputs.subset_pools(spark, d)), "pool-counts")
    return _sized(inputs.subset_design(spark), counts)


@query("combined_truth", compose(
    "select titrated, proportion_id::bigint as proportion_id, titration, case when pool in ('Blueprint-T', 'Blueprint-NK') then 'lymphoid' "
    "else pool end as ref_celltype, round(sum(proportion), 8) as true_proportion from design group by all"))
def combined_truth(spark: SparkSession, d: str) -> DataFrame:
    """Two cell types estimated as one."""
    combined = design.combined_truth(inputs.whole_blood(_counts(spark, d)),
                                     {"Blueprint-T": "lymphoid", "Blueprint-NK": "lymphoid"})
    return as_bigint(rounded(combined, "true_proportion", digits=8), "proportion_id")


LABEL_SQL = """select titrated, proportion_id::bigint as proportion_id,
 string_agg('E' || case when p4 >= 1 then '0' else rtrim(split_part(p4::decimal(10,4)::varchar, '.', 2), '0') end || upper(short), '_'
            order by case when pool = titrated then -1 else place end) as label
 from (select *, round(proportion, 4) as p4, list_position({order}, pool) as place, {short} as short from observed) q group by 1, 2"""
OBSERVED = """select t.titrated, l.proportion_id, l.titration, a.pool, case when a.pool = t.titrated then l.titration
 else a.pool_rows::double / (select sum(b.pool_rows) from abundance b where b.pool <> t.titrated) * (1 - l.titration) end as proportion
 from abundance a cross join targets t cross join levels l"""


@query("proportion_labels", compose(LABEL_SQL.format(
    order=repr(bridge.GROUPS), short=_map("pool", bridge.SHORT_NAMES)), {"observed": OBSERVED}))
def proportion_labels(spark: SparkSession, d: str) -> DataFrame:
    """Mixture labels of a background by observed pool size."""
    observed = _counts(spark, d).withColumn("abundance", F.col("pool_rows").cast("double"))
    plan = design.custom_background(observed, bridge.GROUPS, labels.TITRATION_LEVELS)
    return as_bigint(design.mixture_labels(plan, bridge.SHORT_NAMES, bridge.GROUPS), "proportion_id")


@query("replicate_seeds", compose(
    "select d.titrated, d.proportion_id::bigint as proportion_id, r.replicate, d.pool as cell_type, "
    "('0x' || substr(md5('888|' || d.titrated || '-' || d.proportion_id || '-' || r.replicate), 1, 8))::bigint % 1000001 as seed "
    "from design d cross join (select unnest(range(0, 20)) as replicate) r"))
def replicate_seeds(spark: SparkSession, d: str) -> DataFrame:
    replicated = design.replicate(inputs.whole_blood(_counts(spark, d)), labels.REPLICATES, labels.SEED)
    return as_bigint(replicated.select(*KEYS, "cell_type", "seed"), *ID)


@query("sampling_fractions", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, pool as cell_type, round(fraction, 8) as fraction from mixtures"))
def sampling_fractions(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    replicated = design.replicate(inputs.whole_blood(counts), labels.REPLICATES, labels.SEED)
    fractions = mixing.sampling_fractions(replicated, counts, mixing.total_as_share(counts, inputs.SHARE))
    return as_bigint(rounded(fractions.select(*KEYS, "cell_type", "fraction"), "fraction", digits=8), *ID)


# ---- mixing -----------------------------------------------------------------
def _drawn(spark: SparkSession, d: str, titrated: list[str], replicates: int, share: float, columns: list[str]) -> DataFrame:
    """The drawn rows, as totals."""
    pool = inputs.scored_pools(spark, d)
    counts = materialize(pool_counts(pool), "pool-counts")
    replicated = design.replicate(inputs.whole_blood(counts, titrated), replicates, labels.SEED)
    fractions = mixing.sampling_fractions(replicated, counts, mixing.total_as_share(counts, share))
    return mixing.mix_totals(pool, fractions, labels.SEED, columns)


@query("mix_bernoulli_hash", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, pool as cell_type, count(*) as drawn, "
    "sum(number_molecules)::bigint as molecules, sum(total_k1)::bigint as calls from drawn group by all"))
def mix_bernoulli_hash(spark: SparkSession, d: str) -> DataFrame:
    """What was drawn into each of the 5 x 14 x 20 mixtures."""
    drawn = _drawn(spark, d, bridge.GROUPS, labels.REPLICATES, inputs.SHARE, ["number_molecules", "total_k1"])
    return as_bigint(drawn.select(*KEYS, "cell_type", "drawn", F.col("number_molecules").alias("molecules"), F.col("total_k1").alias("calls")), *ID)


POISSON_SHARE = 1.5
POISSON = {
    "heavy": f"""select d.titrated, d.proportion_id, rep.replicate, d.pool,
 d.proportion * floor((select sum(pool_rows) from pool_counts) * {POISSON_SHARE}) / c.pool_rows as fraction
 from design d join pool_counts c using (pool) cross join (select unnest(range(0, 20)) as replicate) rep""",
    "heavy_words": mixture_words("heavy"),
    "masses": """select titrated, proportion_id, replicate, pool, fraction, i,
 exp(i * ln(fraction) - fraction - lgamma(i + 1)) as mass
 from (select *, unnest(range(0, ceil(fraction + 12 * sqrt(fraction) + 12)::bigint)) as i from heavy where fraction > 1) q""",
    "tails": """select * from (select titrated, proportion_id, replicate, pool, i + 1 as draw_no,
 greatest(0, 1 - sum(mass) over (partition by titrated, proportion_id, replicate, pool order by i)) as threshold from masses) q
 where draw_no = 1 or threshold >= 1 / 2147483647
 union all select titrated, proportion_id, replicate, pool, 1 as draw_no, fraction as threshold from heavy where fraction <= 1 and fraction > 0.00390625""",
    **sparse_tables("heavy"),
    "copies": """select w.titrated, w.proportion_id, w.replicate, w.pool, t.draw_no, p.number_molecules
 from pools p join heavy_words w using (pool) join tails t using (titrated, proportion_id, replicate, pool)
 where (w.mix_a * p.row_x + w.mix_b * p.row_y + w.mix_c) % 2147483647 < 2147483647 * t.threshold
 union all select titrated, proportion_id, replicate, pool, 1 as draw_no, number_molecules from heavy_hits""",
}


@query("mix_poisson_hash", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, pool as cell_type, count(*) as drawn, "
    "max(draw_no)::bigint as most_copies, sum(number_molecules)::bigint as molecules from copies group by all", POISSON))
def mix_poisson_hash(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures larger than all pools: many rows are drawn several times."""
    drawn = _drawn(spark, d, bridge.GROUPS, labels.REPLICATES, POISSON_SHARE, ["number_molecules"])
    return as_bigint(drawn.select(*KEYS, "cell_type", "drawn", "most_copies", F.col("number_molecules").alias("molecules")), *ID)


@query("realised_counts", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, pool as cell_type, "
    f"({SEED_SQL})::bigint as seed, count(*) as drawn from drawn group by all"))
def realised_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn into every mixture, and the seed that draws them again."""
    drawn = _drawn(spark, d, bridge.GROUPS, labels.REPLICATES, inputs.SHARE, [])
    return as_bigint(mixing.realised_counts(drawn), *ID, "seed")


@query("mix_sample_native", compose(
    "select pool as cell_type, 1::bigint as within_five_sigma from pool_counts"))
def mix_sample_native(spark: SparkSession, d: str) -> DataFrame:
    """One mixture by Spark's sampler over all pools, the largest fractions with replacement: whether each count is
    as its fraction lets expect."""
    pool = inputs.scored_pools(spark, d)
    counts = pool_counts(pool)
    fractions = {c: 0.05 * 2.4 ** i for i, c in enumerate(bridge.GROUPS)}
    drawn = mixing.mix_native(pool, fractions, labels.SEED).groupBy("cell_type").agg(F.count(F.lit(1)).alias("drawn"))
    f = relational.label_column("cell_type", {c: str(v) for c, v in fractions.items()}).cast("double")
    spread_ = F.sqrt(F.col("pool_rows") * f * F.when(f > 1, F.lit(1.0)).otherwise(1 - f))
    near = F.abs(F.coalesce("drawn", F.lit(0)) - F.col("pool_rows") * f) <= 5 * spread_
    return counts.join(drawn, "cell_type", "left").select("cell_type", near.cast("bigint").alias("within_five_sigma"))


@query("mixture_scores", compose(
    f"select titrated, proportion_id::bigint as proportion_id, replicate, ({SEED_SQL})::bigint as seed, region_id, "
    f"{rounded_scores()} from mix_scores"))
def mixture_scores(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return as_bigint(rounded(run.scores, *FLAGS), *ID, "seed")


@query("mixture_scores_resumed", compose(
    f"select titrated, proportion_id::bigint as proportion_id, replicate, ({SEED_SQL})::bigint as seed, region_id, "
    f"{rounded_scores()} from mix_scores"))
def mixture_scores_resumed(spark: SparkSession, d: str) -> DataFrame:
    """An experiment that ends after one of two passes and is taken up again."""
    pool = inputs.scored_pools(spark, d)
    counts = materialize(pool_counts(pool), "pool-counts")
    replicated = design.replicate(inputs.whole_blood(counts), labels.REPLICATES, labels.SEED)
    path = scratch_path(spark, "experiment")
    for most in (1, None):
        scores = pipelines.continue_experiment(pool, counts, replicated, inputs.SHARE, path, labels.SEED, steps=2, most_steps=most)
    return as_bigint(rounded(scores, *FLAGS), *ID, "seed")


@query("mixture_scores_rows", compose(
    f"select titrated, proportion_id::bigint as proportion_id, replicate, ({SEED_SQL})::bigint as seed, region_id, "
    f"{rounded_scores()} from row_scores",
    {"row_scores": f"select titrated, proportion_id, replicate, region_id, {sums('1')} from drawn group by all"}))
def mixture_scores_rows(spark: SparkSession, d: str) -> DataFrame:
    """A read counts once, whatever the number of its molecules."""
    pool = inputs.scored_pools(spark, d)
    counts = materialize(pool_counts(pool), "pool-counts")
    replicated = design.replicate(inputs.whole_blood(counts), labels.REPLICATES, labels.SEED)
    scores = pipelines.mixture_scores(pool, counts, replicated, inputs.SHARE, labels.SEED, weighting="rows")
    return as_bigint(rounded(scores, *FLAGS), *ID, "seed")


# Reads as single molecules, over regions whose stored end is the last CpG.
MOLECULE_TABLES = {
    "base_reads": TABLES["reads"],
    "reads": "select r.* exclude (number_molecules), 1 as number_molecules "
             "from (select *, unnest(range(0, number_molecules)) as copy_no from base_reads) r",
    "regions": TABLES["regions"].replace("region_cpg_index_max - 1 as", "region_cpg_index_max as"),
    "pools": TABLES["pools"].replace("|| '|' || region_id)", "|| '|' || region_id || '|' || copy_no)"),
}


@query("mixture_scores_molecules", compose(
    f"select titrated, proportion_id::bigint as proportion_id, replicate, ({SEED_SQL})::bigint as seed, region_id, "
    f"{rounded_scores()} from mix_scores", MOLECULE_TABLES))
def mixture_scores_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of single molecules: reads exploded, counts clamped, inclusive region ends."""
    reads = scoring.explode_molecules(bridge.reads(spark, d))
    regions = intervals.closed_regions(bridge.regions_bed(spark, d), end="inclusive")
    pool = pipelines.scored_pools(pipelines.build_pools(reads, regions, inputs.pool_map(spark, d)),
                                  ["molecule_id", "region_id", "copy_no"])
    counts = materialize(pool_counts(pool), "pool-counts")
    replicated = design.replicate(inputs.whole_blood(counts), labels.REPLICATES, labels.SEED)
    return as_bigint(rounded(pipelines.mixture_scores(pool, counts, replicated, inputs.SHARE, labels.SEED), *FLAGS), *ID, "seed")


# ---- estimates --------------------------------------------------------------
def _out(estimates: DataFrame) -> DataFrame:
    return as_bigint(rounded(estimates, "coeff"), *ID).drop("iterations")


EST_SQL = "select {keys}, round(coeff, 6) as coeff, true as converged, '{name}' as method from {table}"


@query("naive_estimate", compose(EST_SQL.format(keys=EST_KEYS, name="naive", table="naive")))
def naive_estimate(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(estimate.naive(run.scores, inputs.region_map(spark, d), KEYS))


@query("naive_per_sample", compose(
    "select sample_id, ref_celltype, round(avg(frac_alpha_leq_25pct), 6) as coeff, 'naive' as method "
    "from scores join region_map using (region_id) where number_molecules >= 20 group by all"))
def naive_per_sample(spark: SparkSession, d: str) -> DataFrame:
    fit = estimate.naive(inputs.scores(spark, d), inputs.region_map(spark, d), ["sample_id"])
    return rounded(fit.drop("iterations", "converged"), "coeff")


@query("gram_matrix", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, row_celltype, col_celltype, round(value, 6) as value from (" +
    " union all ".join(f"select titrated, proportion_id, replicate, '{a}' as row_celltype, '{b}' as col_celltype, g{i}{j} as value from equations"
                       for i, a in enumerate(TYPES) for j, b in enumerate(TYPES)) + ") q"))
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    rows = estimate.aligned(run.scores, inputs.stored_atlas(spark, d, run.pools), TYPES, keys=KEYS)
    return as_bigint(rounded(estimate.gram_long(rows, KEYS, TYPES), "value"), *ID)


@query("nnls_mixtures", compose(EST_SQL.format(keys=EST_KEYS, name="nnls", table="nnls")))
def nnls_mixtures(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(estimate.nnls(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES))


@query("nnls_qr", compose(EST_SQL.format(keys=EST_KEYS, name="nnls_qr", table="nnls")))
def nnls_qr(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(factors.least_squares(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES))


@query("ols_mixtures", compose(EST_SQL.format(keys=EST_KEYS, name="ols", table="ols"), {
    "sweeps": OLS_SWEEPS, "ols": unpivoted("sweeps", 200, "ols")}))
def ols_mixtures(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(estimate.ols(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES))


@query("nnls_subset", compose(EST_SQL.format(keys=EST_KEYS, name="nnls", table="nnls"), SUBSET_TABLES))
def nnls_subset(spark: SparkSession, d: str) -> DataFrame:
    """Seven cell types in every mixture of the T-subset titrations."""
    return _out(_subset_fit(inputs.subset_experiment(spark, d), spark, d))


def _subset_fit(run: inputs.Experiment, spark: SparkSession, d: str) -> DataFrame:
    matrix = materialize(inputs.subset_atlas(spark, d, run.pools), "atlas")
    return estimate.nnls(run.scores, matrix, KEYS, bridge.SUBSET_TYPES)


SAMPLE_ROWS = {
    "kept": "select sample_id, region_id, frac_alpha_leq_25pct as b from scores where number_molecules >= {cut}",
    "grid": "select s.sample_id, r.region_id from (select distinct sample_id from kept) s cross join (select distinct region_id from kept) r",
    "aligned": "select g.sample_id as titrated, 0 as proportion_id, 0::bigint as replicate, coalesce(k.b, 0) as b, a.* "
               "from grid g left join kept k using (sample_id, region_id) join atlas a using (region_id)",
}


@query("nnls_per_sample", compose(
    "select titrated as sample_id, ref_celltype, round(coeff, 6) as coeff, true as converged, 'nnls' as method from nnls",
    {k: v.replace("{cut}", "80") for k, v in SAMPLE_ROWS.items()}))
def nnls_per_sample(spark: SparkSession, d: str) -> DataFrame:
    """Per sample, covered regions only, and 0 for regions the sample lacks."""
    scores = materialize(inputs.scores(spark, d), "scores")
    matrix = atlas_wide(scores, inputs.sample_map(spark, d), inputs.region_map(spark, d), TYPES)
    fit = estimate.nnls(scores, matrix, ["sample_id"], TYPES, min_molecules=80, missing="zero")
    return rounded(fit.drop("iterations"), "coeff")


@query("nnls_qr_per_sample", compose(
    "select titrated as sample_id, ref_celltype, round(coeff, 6) as coeff, true as converged, 'nnls_qr' as method from nnls",
    {k: v.replace("{cut}", "80") for k, v in SAMPLE_ROWS.items()}))
def nnls_qr_per_sample(spark: SparkSession, d: str) -> DataFrame:
    """The atlas is made orthonormal once; 0 for regions a sample lacks."""
    scores = materialize(inputs.scores(spark, d), "scores")
    matrix = atlas_wide(scores, inputs.sample_map(spark, d), inputs.region_map(spark, d), TYPES)
    fit = factors.least_squares(scores, matrix, ["sample_id"], TYPES, min_molecules=80, missing="zero")
    return rounded(fit.drop("iterations"), "coeff")


@query("outer_estimates", compose(
    "select coalesce(n.sample_id, v.sample_id) as sample_id, coalesce(n.ref_celltype, v.ref_celltype) as ref_celltype, "
    "round(n.coeff, 6) as coeff_nnls, round(v.coeff, 6) as coeff_naive from per_nnls n full join per_naive v "
    "on n.sample_id = v.sample_id and n.ref_celltype = v.ref_celltype", {
        **{k: v.replace("{cut}", "20") for k, v in SAMPLE_ROWS.items()},
        "per_nnls": "select titrated as sample_id, ref_celltype, coeff from nnls",
        "per_naive": "select sample_id, ref_celltype, avg(frac_alpha_leq_25pct) as coeff from scores join region_map using (region_id) "
                     "where number_molecules >= 90 group by all"}))
def outer_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Two estimators side by side; a strict coverage rule leaves gaps in one of them."""
    scores = materialize(inputs.scores(spark, d), "scores")
    matrix = atlas_wide(scores, inputs.sample_map(spark, d), inputs.region_map(spark, d), TYPES)
    both = estimate.nnls(scores, matrix, ["sample_id"], TYPES, min_molecules=20, missing="zero").unionByName(
        estimate.naive(scores, inputs.region_map(spark, d), ["sample_id"], min_molecules=90))
    return rounded(relational.combine_methods(both, ["sample_id", "ref_celltype"], ["nnls", "naive"]),
                   "coeff_nnls", "coeff_naive")


# ---- planted truth ----------------------------------------------------------
def _planted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Exact mixtures of atlas rows by the design, and the atlas they are made of."""
    matrix = inputs.stored_atlas(spark, d)
    plan = inputs.truth(inputs.whole_blood(_counts(spark, d)))
    cells = relational.long(matrix, "region_id", TYPES, "ref_celltype", "score")
    mixed = cells.join(plan, "ref_celltype").groupBy("titrated", "proportion_id", "region_id") \
        .agg(F.sum(F.col("score") * F.col("true_proportion")).alias(labels.SCORE_COLUMN))
    return mixed.withColumn("replicate", F.lit(0)).withColumn("number_molecules", F.lit(100)), matrix


PLANTED = ("select titrated, proportion_id::bigint as proportion_id, ref_celltype, round(true_proportion, 6) as coeff from truth")


def _planted_out(fit: DataFrame) -> DataFrame:
    return as_bigint(rounded(fit.select("titrated", "proportion_id", "ref_celltype", "coeff"), "coeff"), "proportion_id")


@query("nnls_planted", compose(PLANTED))
def nnls_planted(spark: SparkSession, d: str) -> DataFrame:
    mixed, matrix = _planted(spark, d)
    return _planted_out(estimate.nnls(mixed, matrix, KEYS, TYPES))


@query("ols_planted", compose(PLANTED))
def ols_planted(spark: SparkSession, d: str) -> DataFrame:
    mixed, matrix = _planted(spark, d)
    return _planted_out(estimate.ols(mixed, matrix, KEYS, TYPES).withColumn("coeff", F.when(F.abs("coeff") < 1e-6, 0.0).otherwise(F.col("coeff"))))


@query("ols_qr_planted", compose(PLANTED))
def ols_qr_planted(spark: SparkSession, d: str) -> DataFrame:
    mixed, matrix = _planted(spark, d)
    fit = factors.least_squares(mixed, matrix, KEYS, TYPES, nonnegative=False)
    return _planted_out(fit.withColumn("coeff", F.when(F.abs("coeff") < 1e-6, 0.0).otherwise(F.col("coeff"))))


@query("nnhuber_planted", compose(PLANTED))
def nnhuber_planted(spark: SparkSession, d: str) -> DataFrame:
    mixed, matrix = _planted(spark, d)
    return _planted_out(estimate.nonneg_huber(mixed, matrix, KEYS, TYPES, delta=0.1))


@query("nnls_kkt", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, 1::bigint as feasible, 1::bigint as gradient_ok, "
    "1::bigint as complementary from equations"))
def nnls_kkt(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d, stored=True)
    matrix = inputs.stored_atlas(spark, d, run.pools)
    equations = estimate.normal_equations(estimate.aligned(run.scores, matrix, TYPES, keys=KEYS), KEYS, TYPES)
    checked = estimate.optimality(estimate.nnls(run.scores, matrix, KEYS, TYPES), equations, KEYS, TYPES)
    return as_bigint(checked, *ID, "feasible", "gradient_ok", "complementary")


@query("nnhuber_equals_nnls", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, 1::bigint as same from equations"))
def nnhuber_equals_nnls(spark: SparkSession, d: str) -> DataFrame:
    """With delta above every residual the Huber fit is the least-squares fit."""
    run = inputs.experiment(spark, d, stored=True)
    matrix = inputs.stored_atlas(spark, d, run.pools)
    both = estimate.nnls(run.scores, matrix, KEYS, TYPES).unionByName(
        estimate.nonneg_huber(run.scores, matrix, KEYS, TYPES, delta=2.0))
    paired = relational.combine_methods(both, KEYS + ["ref_celltype"], ["nnls", "nonneg_huber"])
    gap = F.max(F.abs(F.col("coeff_nnls") - F.col("coeff_nonneg_huber")))
    return as_bigint(paired.groupBy(*KEYS).agg((gap < 1e-8).cast("bigint").alias("same")), *ID)


def _huber_sweeps(limit: str, scale: bool, lower: bool, rounds: int) -> dict[str, str]:
    """Reweighted fits in SQL: each round takes weights from the current coefficients, sums the
    weighted equations, and makes one coordinate sweep."""
    fitted = " + ".join(f"a.a{i} * x.x{i}" for i in range(5))
    weight = f"least(1, {limit} / greatest(abs(r), 1e-300))"
    sums_sql = ", ".join([f"sum(w * a{i} * a{j}) as g{i}{j}" for i in range(5) for j in range(5)]
                         + [f"sum(w * a{i} * b) as h{i}" for i in range(5)])
    inside = "abs(r) <= 1.35 * sigma"
    new_sigma = (f"greatest(1e-12, sqrt(sum(case when {inside} then r * r else 0 end) / "
                 f"(count(*) - 1.35 * 1.35 * count(*) filter (where not ({inside})))))") if scale else "any_value(sigma)"
    keys = "titrated, proportion_id, replicate"
    state = ", ".join(f"any_value(x{i}) as x{i}" for i in range(5))
    query_sql = (f"select {keys}, it, {new_sigma} as sigma, {state}, {sums_sql} from (select *, {weight} as w from ("
                 f"select x.titrated, x.proportion_id, x.replicate, x.it, x.sigma, x.x0, x.x1, x.x2, x.x3, x.x4, "
                 f"a.a0, a.a1, a.a2, a.a3, a.a4, a.b, a.b - ({fitted}) as r from hsweeps x join aligned a "
                 f"using (titrated, proportion_id, replicate) where x.it < {rounds}) q0) q1 group by {keys}, it")
    for i in range(5):
        others = " - ".join([f"h{i}"] + [f"g{i}{j} * x{j}" for j in range(5) if j != i])
        value = f"({others}) / g{i}{i}"
        value = f"greatest(0.0, {value})" if lower else value
        query_sql = f"select * exclude (x{i}), {value} as x{i} from ({query_sql}) p{i}"
    return {
        "hsweeps": (f"select distinct {keys}, 0 as it, 0.05::double as sigma, 0.2::double as x0, 0.2::double as x1, 0.2::double as x2, "
                    f"0.2::double as x3, 0.2::double as x4 from aligned union all "
                    f"select {keys}, it + 1, sigma, x0, x1, x2, x3, x4 from ({query_sql}) q"),
        "hfit": unpivoted("hsweeps", rounds, "huber"),
    }


@query("nnhuber_mixtures", compose(EST_SQL.format(keys=EST_KEYS, name="nonneg_huber", table="hfit"),
                                   _huber_sweeps("0.02", False, True, 150)))
def nnhuber_mixtures(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(estimate.nonneg_huber(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES, delta=0.02))


@query("huber_mixtures", compose(EST_SQL.format(keys=EST_KEYS, name="huber", table="hfit"),
                                 _huber_sweeps("1.35 * sigma", True, False, 150)))
def huber_mixtures(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    return _out(estimate.huber(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES, epsilon=1.35))


TRUTH_JOIN = "join truth t using (titrated, proportion_id, ref_celltype)"


@query("estimate_mse", compose(
    f"select e.ref_celltype, t.titration, round(avg(pow(coeff - true_proportion, 2)), 8) as mse from nnls e {TRUTH_JOIN} group by all"))
def estimate_mse(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    fit = estimate.nnls(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES)
    errors = estimate.squared_error(fit, run.truth(), ["titrated", "proportion_id", "ref_celltype"],
                                    ["ref_celltype", "titration"])
    return rounded(errors, "mse", digits=8)


@query("clip_versus_constrained", compose(
    f"select method, e.titrated, round(avg(pow(coeff - true_proportion, 2)), 8) as mse from (select *, 'nnls' as method from nnls "
    f"union all select titrated, proportion_id, replicate, ref_celltype, greatest(0, coeff) as coeff, 'ols_clipped' as method from ols) e {TRUTH_JOIN} group by all",
    {"osweeps": OLS_SWEEPS.replace("sweeps", "osweeps"), "ols": unpivoted("osweeps", 200, "ols")}))
def clip_versus_constrained(spark: SparkSession, d: str) -> DataFrame:
    """Error of clipping after an unconstrained fit against fitting with the constraint."""
    run = inputs.experiment(spark, d, stored=True)
    matrix = inputs.stored_atlas(spark, d, run.pools)
    both = estimate.nnls(run.scores, matrix, KEYS, TYPES).unionByName(estimate.ols(run.scores, matrix, KEYS, TYPES, clip=True))
    errors = estimate.squared_error(both, run.truth(), ["titrated", "proportion_id", "ref_celltype"], ["method", "titrated"])
    return rounded(errors, "mse", digits=8)


# ---- evaluation -------------------------------------------------------------
def _titrated_naive(spark: SparkSession, d: str) -> DataFrame:
    """Naive estimates of the titrated cell type of each experiment, with their truth."""
    run = inputs.experiment(spark, d)
    fit = estimate.naive(run.scores, inputs.region_map(spark, d), KEYS)
    own = run.truth().where(F.col("is_titrated") == 1)
    return evaluate.with_truth(fit, own, ["titrated", "proportion_id", "ref_celltype"])


def _titrated_nnls(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d)
    fit = estimate.nnls(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES)
    own = run.truth().where(F.col("is_titrated") == 1)
    return evaluate.with_truth(fit, own, ["titrated", "proportion_id", "ref_celltype"])


OWN = "select e.ref_celltype, true_proportion as p, coeff, replicate from {table} e " + TRUTH_JOIN + " where is_titrated = 1"
DETECT = "select ref_celltype, p, count(*) as replicates, avg((coeff > {cut})::int) as raw_rate from own group by all"
WITHIN = "select ref_celltype, p, count(*) as replicates, avg((coeff >= p - p * 0.3 and coeff <= p + p * 0.3)::int) as raw_rate from own group by all"
ZERO = "select *, case when p = 0 then 0.0 else raw_rate end as rate from raw_rates"
RATES_OUT = "select ref_celltype, p as true_proportion, replicates, round(raw_rate, 6) as raw_rate, round(rate, 6) as rate from rates"
NAIVE_CUT, NNLS_CUT = 0.02, 0.005


def _rates(table: str, rule: str) -> dict[str, str]:
    return {"own": OWN.format(table=table), "raw_rates": rule, "rates": ZERO, "steps": rate_steps("rates")}


@query("detection_rate", compose(RATES_OUT, _rates("naive", DETECT.format(cut=NAIVE_CUT))))
def detection_rate(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.detection_rate(_titrated_naive(spark, d), ["ref_celltype"], NAIVE_CUT)
    return rounded(rates, "raw_rate", "rate")


@query("within_tolerance", compose(RATES_OUT, _rates("naive", WITHIN)))
def within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.tolerance_rate(_titrated_naive(spark, d), ["ref_celltype"]), "raw_rate", "rate")


@query("lod95_detect", compose(lod_from("steps"), _rates("naive", DETECT.format(cut=NAIVE_CUT))))
def lod95_detect(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.detection_rate(_titrated_naive(spark, d), ["ref_celltype"], NAIVE_CUT)
    return rounded(evaluate.limit_of_detection(rates, ["ref_celltype"]), "lod")


@query("lod95_tolerance", compose(lod_from("steps"), _rates("naive", WITHIN)))
def lod95_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.tolerance_rate(_titrated_naive(spark, d), ["ref_celltype"])
    return rounded(evaluate.limit_of_detection(rates, ["ref_celltype"]), "lod")


@query("lod95_nnls", compose(
    "select *, round(round(lod, 5) * 100, 3) as lod_percent from (" + lod_from("steps") + ") z",
    _rates("nnls", DETECT.format(cut=NNLS_CUT))))
def lod95_nnls(spark: SparkSession, d: str) -> DataFrame:
    """Limit of detection per cell type, by least squares, in one job."""
    rates = evaluate.detection_rate(_titrated_nnls(spark, d), ["ref_celltype"], NNLS_CUT)
    return rounded(evaluate.lod_text(evaluate.limit_of_detection(rates, ["ref_celltype"])), "lod").drop("lod_rounded")


def _titrated_huber(spark: SparkSession, d: str, nonnegative: bool) -> DataFrame:
    run = inputs.experiment(spark, d)
    matrix = inputs.stored_atlas(spark, d, run.pools)
    fit = (estimate.nonneg_huber(run.scores, matrix, KEYS, TYPES, delta=0.02) if nonnegative
           else estimate.huber(run.scores, matrix, KEYS, TYPES, epsilon=1.35))
    own = run.truth().where(F.col("is_titrated") == 1)
    return evaluate.with_truth(fit, own, ["titrated", "proportion_id", "ref_celltype"])


@query("lod95_huber", compose(lod_from("steps"), {
    **_huber_sweeps("1.35 * sigma", True, False, 150), **_rates("hfit", DETECT.format(cut=NNLS_CUT))}))
def lod95_huber(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.detection_rate(_titrated_huber(spark, d, False), ["ref_celltype"], NNLS_CUT)
    return rounded(evaluate.limit_of_detection(rates, ["ref_celltype"]), "lod")


@query("lod95_nnhuber", compose(lod_from("steps"), {
    **_huber_sweeps("0.02", False, True, 150), **_rates("hfit", DETECT.format(cut=NNLS_CUT))}))
def lod95_nnhuber(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.detection_rate(_titrated_huber(spark, d, True), ["ref_celltype"], NNLS_CUT)
    return rounded(evaluate.limit_of_detection(rates, ["ref_celltype"]), "lod")


@query("background_check_huber", compose(
    f"select e.titrated, t.titration, e.ref_celltype, round(avg(coeff - true_proportion), 6) as bias, "
    f"round(avg(pow(coeff - true_proportion, 2)), 8) as mse from hfit e {TRUTH_JOIN} group by all",
    _huber_sweeps("1.35 * sigma", True, False, 150)))
def background_check_huber(spark: SparkSession, d: str) -> DataFrame:
    """Every cell type of every mixture against its true proportion, by the robust fit."""
    run = inputs.experiment(spark, d)
    fit = materialize(estimate.huber(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES, epsilon=1.35), "estimates")
    checked = evaluate.background_check(fit, run.truth(), ["titrated", "proportion_id", "ref_celltype"])
    return rounded(rounded(checked.select("titrated", "titration", "ref_celltype", "bias", "mse"), "bias"), "mse", digits=8)


@query("lod95_subset", compose(lod_from("steps"), {**SUBSET_TABLES, **_rates("nnls", DETECT.format(cut=NNLS_CUT))}))
def lod95_subset(spark: SparkSession, d: str) -> DataFrame:
    """Limit of detection of T subsets, as a share of all cells."""
    run = inputs.subset_experiment(spark, d)
    own = run.truth().where(F.col("is_titrated") == 1)
    found = evaluate.with_truth(_subset_fit(run, spark, d), own, ["titrated", "proportion_id", "ref_celltype"])
    return rounded(evaluate.limit_of_detection(evaluate.detection_rate(found, ["ref_celltype"], NNLS_CUT), ["ref_celltype"]), "lod")


@query("background_check_subset", compose(
    f"select e.titrated, t.titration, e.ref_celltype, round(avg(coeff - true_proportion), 6) as bias, "
    f"round(avg(pow(coeff - true_proportion, 2)), 8) as mse from nnls e {TRUTH_JOIN} group by all", SUBSET_TABLES))
def background_check_subset(spark: SparkSession, d: str) -> DataFrame:
    """The other T subsets and the background while one subset is titrated, against their true proportions."""
    run = inputs.subset_experiment(spark, d)
    checked = evaluate.background_check(materialize(_subset_fit(run, spark, d), "estimates"), run.truth(), ["titrated", "proportion_id", "ref_celltype"])
    return rounded(rounded(checked.select("titrated", "titration", "ref_celltype", "bias", "mse"), "bias"), "mse", digits=8)


@query("lod95_nnls_tolerance", compose(lod_from("steps"), _rates("nnls", WITHIN)))
def lod95_nnls_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rates = evaluate.tolerance_rate(_titrated_nnls(spark, d), ["ref_celltype"])
    return rounded(evaluate.limit_of_detection(rates, ["ref_celltype"]), "lod")


@query("lod_bundle", compose(RATES_OUT, _rates("naive", DETECT.format(cut=NAIVE_CUT))))
def lod_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Rates saved and loaded again, as the limit of detection is often redrawn."""
    path = scratch_path(spark, "lod")
    tables.write_bundle(evaluate.detection_rate(_titrated_naive(spark, d), ["ref_celltype"], NAIVE_CUT), path)
    return rounded(tables.read_bundle(spark, path), "raw_rate", "rate")


FIVE = ("count(*) as n, round(min(coeff), 6) as min, round(quantile_cont(coeff, 0.25), 6) as q1, "
        "round(quantile_cont(coeff, 0.5), 6) as median, round(quantile_cont(coeff, 0.75), 6) as q3, round(max(coeff), 6) as max")
BOX = ["min", "q1", "median", "q3", "max"]


@query("box_summary", compose(
    f"select ref_celltype, p as true_proportion, {FIVE} from own group by all", {"own": OWN.format(table="naive")}))
def box_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.box_summary(_titrated_naive(spark, d), ["ref_celltype", "true_proportion"]), *BOX)


@query("background_check", compose(
    f"select e.titrated, t.titration, e.ref_celltype, is_titrated::bigint as is_titrated, round(any_value(true_proportion), 6) as true_proportion, {FIVE}, "
    f"round(avg(coeff - true_proportion), 6) as bias, round(avg(pow(coeff - true_proportion, 2)), 8) as mse from nnls e {TRUTH_JOIN} group by all"))
def background_check(spark: SparkSession, d: str) -> DataFrame:
    """Every cell type of every mixture against its true proportion."""
    run = inputs.experiment(spark, d)
    fit = materialize(estimate.nnls(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES), "estimates")
    checked = evaluate.background_check(fit, run.truth(), ["titrated", "proportion_id", "ref_celltype"])
    return as_bigint(rounded(rounded(checked, "true_proportion", "bias", *BOX), "mse", digits=8), "is_titrated")


PAIRED = {"paired": "select titrated, proportion_id, replicate, ref_celltype, v.coeff as coeff_naive, n.coeff as coeff_nnls "
                    "from naive v join nnls n using (titrated, proportion_id, replicate, ref_celltype)"}


def _paired(spark: SparkSession, d: str) -> DataFrame:
    run = inputs.experiment(spark, d, stored=True)
    both = estimate.naive(run.scores, inputs.region_map(spark, d), KEYS).unionByName(
        estimate.nnls(run.scores, inputs.stored_atlas(spark, d, run.pools), KEYS, TYPES))
    return relational.combine_methods(both, KEYS + ["ref_celltype"], ["naive", "nnls"], how="inner")


@query("paired_methods", compose(
    f"select {EST_KEYS}, round(coeff_naive, 6) as coeff_naive, round(coeff_nnls, 6) as coeff_nnls from paired", PAIRED))
def paired_methods(spark: SparkSession, d: str) -> DataFrame:
    return as_bigint(rounded(_paired(spark, d), "coeff_naive", "coeff_nnls"), *ID)


@query("paired_agreement", compose(
    "select ref_celltype, count(*) as n, round(avg(coeff_nnls - coeff_naive), 6) as mean_difference, "
    "round(max(abs(coeff_nnls - coeff_naive)), 6) as max_difference, round(avg((coeff_nnls > coeff_naive)::int), 6) as share_above_line "
    "from paired group by all", PAIRED))
def paired_agreement(spark: SparkSession, d: str) -> DataFrame:
    agreement = evaluate.paired_agreement(_paired(spark, d), "naive", "nnls", ["ref_celltype"])
    return rounded(agreement, "mean_difference", "max_difference", "share_above_line")
