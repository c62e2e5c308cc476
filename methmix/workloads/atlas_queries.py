"""Atlas building, its summaries and matrix analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methmix import bridge, labels
from methmix.operators import atlas, factors, matrix, relational
from methmix.workloads import inputs
from methmix.workloads.base_sql import SUBSET_TABLES, _map, compose
from methmix.workloads.registry import as_bigint, query, rounded

TYPES = bridge.CELL_TYPES
NAMED = ", ".join(f"round(a{i}, 6) as {c}" for i, c in enumerate(TYPES))


@query("atlas_long", compose("select region_id, ref_celltype, round(score, 6) as score from cells"))
def atlas_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inputs.cells(spark, d), "score")


@query("atlas_wide", compose("select region_id, " + ", ".join(
    f"round(max(case when ref_celltype = '{c}' then score end), 6) as {c}" for c in TYPES) + " from cells group by region_id"))
def atlas_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = atlas.atlas_wide(inputs.scores(spark, d), inputs.sample_map(spark, d), inputs.region_map(spark, d),
                            TYPES, complete=False)
    return rounded(wide, *TYPES)


@query("atlas_complete_rows", compose(
    "select region_id, " + ", ".join(f"round(a{i}, 6) as {c}" for i, c in enumerate(TYPES)) + " from strict_atlas", {
        "strict": "select s.region_id, m.ref_celltype, avg(s.frac_alpha_leq_25pct) as score from scores s join sample_map m using (sample_id) "
                  "where s.number_molecules >= 80 and s.region_id in (select region_id from region_map) group by all",
        "strict_atlas": "select region_id, " + ", ".join(
            f"max(case when ref_celltype = '{c}' then score end) as a{i}" for i, c in enumerate(TYPES))
            + " from strict group by region_id having count(*) = 5"}))
def atlas_complete_rows(spark: SparkSession, d: str) -> DataFrame:
    """A stricter coverage filter, which leaves some regions incomplete; those are dropped."""
    wide = atlas.atlas_wide(inputs.scores(spark, d), inputs.sample_map(spark, d), inputs.region_map(spark, d),
                            TYPES, min_molecules=80)
    return rounded(wide, *TYPES)


@query("atlas_ordered", compose(
    f"select a.region_id, {NAMED}, list_position({TYPES!r}, m.ref_celltype) - 1::bigint as place from atlas a "
    f"join region_map m on m.region_id = a.region_id"))
def atlas_ordered(spark: SparkSession, d: str) -> DataFrame:
    ordered = atlas.ordered_atlas(inputs.atlas_matrix(spark, d), inputs.region_map(spark, d), TYPES)
    return as_bigint(rounded(ordered, *TYPES), "place")


@query("atlas_unpivot", compose("select region_id, ref_celltype, round(score, 6) as score from atlas_cells"))
def atlas_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inputs.atlas_cells(spark, d), "score")


@query("sample_matrix", compose(
    "select sample_id, " + ", ".join(
        f"round(max(case when region_id = 'r{r}' then frac_alpha_leq_25pct end), 6) as r{r}" for r in range(40))
    + " from scores group by sample_id"))
def sample_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Samples as rows, regions as columns."""
    names = [f"r{r}" for r in range(bridge.LOCI // 5)]
    return rounded(relational.wide(inputs.scores(spark, d), "sample_id", "region_id", labels.SCORE_COLUMN, names), *names)


def _variant(sample_table, region_table, groups_sql: str, types: list[str]) -> str:
    source = f"select *, {groups_sql} as grp from samples where source = 'blueprint_loyfer2022'"
    return compose("select region_id, " + ", ".join(
        f"round(max(case when ref_celltype = '{c}' then score end), 6) as {c}" for c in types)
        + " from variant group by region_id having count(*) = " + str(len(types)), {
            "grouped": source,
            "variant_samples": f"select distinct sample_id, {_map('grp', sample_table)} as ref_celltype from grouped",
            "variant_regions": f"select distinct region_id, {_map('target_celltype', region_table)} as ref_celltype from panel where v23_conv = 1",
            "variant": "select s.region_id, m.ref_celltype, avg(s.frac_alpha_leq_25pct) as score from scores s "
                       "join variant_samples m using (sample_id) where m.ref_celltype is not null and s.number_molecules >= 10 "
                       "and s.region_id in (select region_id from variant_regions where ref_celltype is not null) group by all"})


SPLIT_TYPES = ["immune_b", "immune_cd4", "immune_cd8", "immune_nk", "immune_dend_plus_macro_plus_mono", "immune_neutro"]
SUBSET_TYPES = bridge.SUBSET_TYPES


@query("atlas_split", _variant(labels.SAMPLE_LABELS_SPLIT, labels.REGION_LABELS_SPLIT, "sample_group", SPLIT_TYPES))
def atlas_split(spark: SparkSession, d: str) -> DataFrame:
    """CD4 and CD8 as two cell types."""
    wide = atlas.atlas_wide(inputs.scores(spark, d), inputs.sample_map(spark, d, labels.SAMPLE_LABELS_SPLIT),
                            inputs.region_map(spark, d, labels.REGION_LABELS_SPLIT), SPLIT_TYPES)
    return rounded(wide, *SPLIT_TYPES)


@query("atlas_subset", compose("select region_id, " + ", ".join(
    f"round(a{i}, 6) as {c}" for i, c in enumerate(SUBSET_TYPES)) + " from atlas", SUBSET_TABLES))
def atlas_subset(spark: SparkSession, d: str) -> DataFrame:
    """T cells by subset, from the detailed cell type of the sample."""
    return rounded(inputs.subset_atlas(spark, d), *SUBSET_TYPES)


FENCES = """select ref_celltype, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.75) as q3 from atlas_cells group by 1"""
FLAGGED = """select c.*, q1, q3, (score < q1 - 1.5 * (q3 - q1) or score > q3 + 1.5 * (q3 - q1))::bigint as is_outlier
 from atlas_cells c join fences f using (ref_celltype)"""


@query("atlas_iqr_outliers", compose(
    "select region_id, ref_celltype, round(score, 6) as score, round(q1, 6) as q1, round(q3, 6) as q3, is_outlier from flagged",
    {"fences": FENCES, "flagged": FLAGGED}))
def atlas_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return as_bigint(rounded(atlas.outlier_flags(inputs.atlas_cells(spark, d)), "score", "q1", "q3"), "is_outlier")


@query("atlas_mean_variance", compose(
    "select ref_celltype, round(avg(score), 6) as mean_all, round(var_samp(score), 6) as variance_all, "
    "round(avg(score) filter (where is_outlier = 0), 6) as mean_inside, "
    "round(var_samp(score) filter (where is_outlier = 0), 6) as variance_inside from flagged group by 1",
    {"fences": FENCES, "flagged": FLAGGED}))
def atlas_mean_variance(spark: SparkSession, d: str) -> DataFrame:
    summary = atlas.mean_variance(atlas.outlier_flags(inputs.atlas_cells(spark, d)))
    return rounded(summary, "mean_all", "variance_all", "mean_inside", "variance_inside")


@query("specific_region_scores", compose(
    "select c.region_id, c.ref_celltype, round(score, 6) as score from atlas_cells c join region_map m "
    "on m.region_id = c.region_id and m.ref_celltype = c.ref_celltype"))
def specific_region_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(atlas.specific_scores(inputs.atlas_cells(spark, d), inputs.region_map(spark, d)), "score")


# ---- matrix analysis --------------------------------------------------------
@query("svd_atlas")
def svd_atlas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.singular_values(inputs.atlas_matrix(spark, d), TYPES), "singular_value")


def _powers() -> dict[str, str]:
    k = range(5)
    entries = ", ".join(f"sum(a{i} * a{j}) as m{i}{j}" for i in k for j in k)
    tables = {"power_gram": f"select {entries} from atlas", "power1": "select * from power_gram"}
    for p in range(2, 6):
        cells = ", ".join(" + ".join(f"g.m{i}{n} * q.m{n}{j}" for n in k) + f" as m{i}{j}" for i in k for j in k)
        tables[f"power{p}"] = f"select {cells} from power_gram g cross join power{p - 1} q"
    return tables


@query("svd_power_sums", compose(" union all ".join(
    f"select {p}::bigint as power, round({' + '.join(f'm{i}{i}' for i in range(5))}, 6) as power_sum from power{p}" for p in range(1, 6)), _powers()))
def svd_power_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the even powers of the singular values. Five of them determine five values, and
    each is the trace of a power of the Gram matrix, which SQL can take."""
    return _power_sums(matrix.singular_values(inputs.atlas_matrix(spark, d), TYPES))


def _power_sums(values: DataFrame) -> DataFrame:
    sums = values.agg(*[F.sum(F.pow("singular_value", F.lit(2 * p))).alias(str(p)) for p in range(1, 6)])
    long = sums.unpivot([], [str(p) for p in range(1, 6)], "power", "power_sum")
    return rounded(as_bigint(long, "power"), "power_sum")


@query("svd_qr", compose(" union all ".join(
    f"select {p}::bigint as power, round({' + '.join(f'm{i}{i}' for i in range(5))}, 6) as power_sum from power{p}" for p in range(1, 6)), _powers()))
def svd_qr(spark: SparkSession, d: str) -> DataFrame:
    """The same sums from singular values by orthogonal factors."""
    return _power_sums(factors.singular_values(inputs.atlas_matrix(spark, d), TYPES))


@query("standardized_scores", compose(
    "select sample_id, region_id, round(case when sd > 1e-12 then (score - mean) / sd else 0 end, 6) as z from "
    "(select sample_id, region_id, frac_alpha_leq_25pct as score from scores) s join "
    "(select region_id, avg(frac_alpha_leq_25pct) as mean, stddev_pop(frac_alpha_leq_25pct) as sd from scores group by 1) m using (region_id)"))
def standardized_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.standardized(inputs.scores(spark, d)), "z")


Z_SCORES = {
    "samples_seen": "select distinct sample_id from scores",
    "raw_matrix": "select p.sample_id, r.region_id, coalesce(s.frac_alpha_leq_25pct, 0) as score from samples_seen p "
                  "cross join (select distinct region_id from scores) r left join scores s using (sample_id, region_id)",
    "z_moments": "select region_id, avg(score) as mean, stddev_pop(score) as sd from raw_matrix group by 1",
    "z": "select sample_id, region_id, case when sd > 1e-12 then (score - mean) / sd else 0 end as z from raw_matrix join z_moments using (region_id)",
    "z_products": "select a.sample_id, b.sample_id as other_id, sum(a.z * b.z) as product from z a join z b using (region_id) group by all",
}


@query("pca_samples", compose(
    "select sample_id, sample_group, age, sex, round(sum(product * product) over (partition by sample_id), 4) as weight "
    "from (select sample_id, other_id, product from z_products) p join described using (sample_id) qualify other_id = min(other_id) over (partition by sample_id)",
    {**Z_SCORES, "described": "select s.sample_id, s.sample_group, s.age, d.donor_sex as sex from (select distinct sample_id, sample_group, age from samples) s "
                              "join (select sample_id, min(donor_sex) as donor_sex from donors group by 1) d using (sample_id)"}))
def pca_samples(spark: SparkSession, d: str) -> DataFrame:
    """All component scores with the metadata of the sample, as one number that does not depend on their signs: with K
    the samples' products and l the variances, the sum of l x score^2 over components is the sum of a row of K^2."""
    found = matrix.principal_components(inputs.scores(spark, d), 1000)
    weights = (found.scores ** 2) @ found.variances[:found.scores.shape[1]]
    table = spark.createDataFrame([(s, float(w)) for s, w in zip(found.samples, weights)], "sample_id string, weight double")
    described = relational.describe_samples(bridge.samples(spark, d), bridge.donors(spark, d))
    return rounded(table.join(described, "sample_id"), "weight", digits=4)


@query("pca_products", compose("select sample_id, other_id, round(product, 6) as product from z_products", Z_SCORES))
def pca_products(spark: SparkSession, d: str) -> DataFrame:
    """All component scores of two samples multiplied and added up: the samples' product over the regions."""
    wide = matrix.pca_scores(inputs.scores(spark, d), 1000)
    names = [c for c in wide.columns if c != "sample_id"]
    rows = wide.select("sample_id", F.array(*names).alias("a"))
    others = rows.select(F.col("sample_id").alias("other_id"), F.col("a").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rounded(rows.crossJoin(F.broadcast(others)).select("sample_id", "other_id", (dot + 0.0).alias("product")), "product")


@query("explained_variance", compose(
    "select 1::bigint as power, 1.0::double as power_sum union all select 2::bigint as power, round(sum(product * product) / "
    "pow((select sum(product) from z_products where sample_id = other_id), 2), 6) as power_sum from z_products", Z_SCORES))
def explained_variance(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the shares of all components and of their squares, which SQL can take from traces."""
    shares = matrix.explained_variance(inputs.scores(spark, d), 1000)
    sums = shares.agg(F.sum("share").alias("1"), F.sum(F.col("share") ** 2).alias("2"))
    return rounded(as_bigint(sums.unpivot([], ["1", "2"], "power", "power_sum"), "power"), "power_sum")
