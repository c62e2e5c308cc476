"""Sources, sinks, filters, labels, joins and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methmix import bridge, labels, schema
from methmix.functions.hashing import derived_seed
from methmix.operators import atlas, intervals, relational, scoring
from methmix.session import materialize, scratch_path
from methmix.sources import tables
from methmix.workloads import inputs
from methmix.workloads.base_sql import FLAGS, SUM_COLUMNS, compose, rounded_scores, sums
from methmix.workloads.registry import as_bigint, query, rounded

SCORE_KEYS = "sample_id, region_id, "


# ---- sources and sinks ------------------------------------------------------
@query("scan_reads", compose(
    "select sample_id, molecule_id, chr, number_molecules::bigint as number_molecules, cpg_index_min, "
    "cpg_index_max, pat_string from reads"))
def scan_reads(spark: SparkSession, d: str) -> DataFrame:
    return as_bigint(bridge.reads(spark, d).select(*schema.READ_COLUMNS), "number_molecules")


@query("union_by_name", compose(
    "select sample_id, count(*) as reads, sum(number_molecules)::bigint as molecules from ("
    "select * from reads union all select * from reads) q group by sample_id"))
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Two stored read tables whose columns come in another order, as one table."""
    first, second = scratch_path(spark, "reads"), scratch_path(spark, "reads")
    reads = bridge.reads(spark, d)
    reads.write.parquet(first)
    reads.select(*reversed(reads.columns)).write.parquet(second)
    both = tables.read_reads(spark, first, second)
    return both.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("reads"), F.sum("number_molecules").alias("molecules"))


@query("union_positional", compose(
    "select region_id, count(*) as rows from (select region_id from regions union all select region_id from panel) q group by 1"))
def union_positional(spark: SparkSession, d: str) -> DataFrame:
    names = bridge.panel(spark, d).select(F.col("region_id").alias("panel_region"))
    both = relational.union_positional([bridge.regions(spark, d).select("region_id"), names])
    return both.groupBy("region_id").agg(F.count(F.lit(1)).alias("rows"))


@query("tsv_roundtrip", compose(f"select {SCORE_KEYS}{rounded_scores()} from scores"))
def tsv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Region scores written as gzip TSV and read back by header name."""
    path = scratch_path(spark, "scores-tsv")
    tables.write_tsv(inputs.scores(spark, d), path)
    return rounded(tables.read_tsv(spark, path, schema.scores_schema({"sample_id": T.StringType()})), *FLAGS)


@query("tsv_pruned", compose("select region_id, number_molecules from scores"))
def tsv_pruned(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "scores-tsv")
    tables.write_tsv(inputs.scores(spark, d), path)
    return tables.read_tsv(spark, path, schema.scores_schema({"sample_id": T.StringType()}),
                           ["region_id", "number_molecules"])


@query("bed_regions", compose("select * from regions_bed"))
def bed_regions(spark: SparkSession, d: str) -> DataFrame:
    """A headerless BED file with more fields than the six that are read."""
    path = scratch_path(spark, "bed")
    bed = bridge.regions_bed(spark, d).withColumn("name", F.lit("probe")).withColumn("gc", F.lit(0.5))
    tables.write_tsv(bed, path, header=False, compression="none")
    return tables.read_bed(spark, path)


@query("pool_counts", compose("select pool as cell_type, pool_rows from pool_counts"))
def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pools stored by cell type, loaded by cell type, counted in one job."""
    path = scratch_path(spark, "pools")
    tables.write_pools(inputs.pools(spark, d), path)
    loaded = tables.load_pools(spark, path, bridge.GROUPS)
    return tables.pool_counts(scoring.observed_reads(scoring.trim_reads(loaded)))


@query("experiment_folders", compose(
    "select titrated, proportion_id::bigint as proportion_id, replicate, count(*) as regions, "
    "sum(number_molecules)::bigint as molecules from mix_scores group by all"))
def experiment_folders(spark: SparkSession, d: str) -> DataFrame:
    """Mixture scores stored by mixture key and read back with the keys as columns."""
    path = scratch_path(spark, "experiment")
    table = inputs.experiment(spark, d).scores
    tables.write_experiment(table.repartition("titrated", "proportion_id"), path, "titrated", "proportion_id")
    loaded = tables.read_experiment(spark, path, table.schema)
    return as_bigint(loaded.groupBy(*inputs.KEYS).agg(
        F.count(F.lit(1)).alias("regions"), F.sum("number_molecules").alias("molecules")),
        "proportion_id", "replicate")


# ---- filters and labels -----------------------------------------------------
@query("filter_panel", compose(
    "select distinct region_id, subpanel, target_celltype, "
    "case when contains(target_celltype, 'Mono') or contains(target_celltype, 'NK') then 1::bigint else 0::bigint end "
    "as innate from panel where v23_conv = 1"))
def filter_panel(spark: SparkSession, d: str) -> DataFrame:
    chosen = atlas.panel_regions(bridge.panel(spark, d))
    return as_bigint(chosen.withColumn("innate", relational.contains_any("target_celltype", ["Mono", "NK"])), "innate")


@query("membership_filter", compose(
    "select sample_id, sample_group from samples where source = 'blueprint_loyfer2022' "
    "and sample_group in ('Blueprint-B', 'Blueprint-CD4', 'Blueprint-NK')"))
def membership_filter(spark: SparkSession, d: str) -> DataFrame:
    own = bridge.samples(spark, d).where(F.col("source") == inputs.SOURCE)
    return relational.in_list(own, "sample_group", ["Blueprint-B", "Blueprint-CD4", "Blueprint-NK"]) \
        .select("sample_id", "sample_group")


@query("coverage_filter", compose("select sample_id, region_id, number_molecules from scores where number_molecules >= 80"))
def coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    return relational.min_coverage(inputs.scores(spark, d), 80).select("sample_id", "region_id", "number_molecules")


@query("observed_filter", compose(
    "select region_id, count(*) as kept from trimmed where length(replace(replace(t, 'C', ''), 'T', '')) <= length(t) - 3 group by 1"))
def observed_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = scoring.observed_reads(scoring.trim_reads(inputs.region_reads(spark, d)))
    return kept.groupBy("region_id").agg(F.count(F.lit(1)).alias("kept"))


@query("semi_regions", compose(
    "select sample_id, region_id, number_molecules from scores where region_id in (select region_id from panel where v23_conv = 1)"))
def semi_regions(spark: SparkSession, d: str) -> DataFrame:
    listed = atlas.panel_regions(bridge.panel(spark, d))
    return relational.rows_with_key(inputs.scores(spark, d), listed, "region_id") \
        .select("sample_id", "region_id", "number_molecules")


@query("anti_samples", compose(
    "select distinct sample_id from reads where sample_id not in (select sample_id from donors)"))
def anti_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with reads but without donor metadata."""
    known = bridge.donors(spark, d).select(F.col("SAMPLE_ID").alias("sample_id"))
    return relational.keys_missing_from(bridge.reads(spark, d), known, "sample_id")


@query("relabel_samples", compose("select sample_id, ref_celltype from sample_map"))
def relabel_samples(spark: SparkSession, d: str) -> DataFrame:
    return inputs.sample_map(spark, d)


@query("relabel_regions", compose("select region_id, ref_celltype from region_map"))
def relabel_regions(spark: SparkSession, d: str) -> DataFrame:
    """The same with the label table joined instead of written into the expression."""
    table = spark.createDataFrame(list(labels.REGION_LABELS_T_COMBINED.items()), ["target", "ref_celltype"])
    schema.assert_unique_keys(table, "target")
    listed = atlas.panel_regions(bridge.panel(spark, d)).select("region_id", "target_celltype")
    return relational.label_join(listed, "target_celltype", table, "target") \
        .select("region_id", "ref_celltype").distinct()


@query("relabel_conditional", compose(
    "select sample_id, case when cell_type = 'regulatory T cell' then 't_reg' "
    "when cell_type in ('CD4-positive, alpha-beta T cell', 'CD8-positive, alpha-beta T cell') then 't_naive' "
    "else sample_group end as subset_group, "
    "case when sample_group in ('Blueprint-CD4', 'Blueprint-CD8') then 'Blueprint-T' else sample_group end as t_group from samples"))
def relabel_conditional(spark: SparkSession, d: str) -> DataFrame:
    return bridge.samples(spark, d).select(
        "sample_id",
        relational.relabel_where("cell_type", labels.T_SUBSET_CELL_TYPES, "sample_group").alias("subset_group"),
        relational.override("sample_group", labels.T_COMBINED_GROUPS).alias("t_group"))


@query("override_labels", compose(
    "select region_id, case when ref_celltype = 'immune_t' then 'immune_cd4_t' else ref_celltype end as ref_celltype from region_map"))
def override_labels(spark: SparkSession, d: str) -> DataFrame:
    return inputs.region_map(spark, d).withColumn(
        "ref_celltype", relational.override("ref_celltype", {"immune_t": "immune_cd4_t"}))


@query("number_replicates", compose(
    "select sample_id, source, sample_group, row_number() over (partition by source, sample_group order by sample_id) - 1 "
    "as replicate from samples"))
def number_replicates(spark: SparkSession, d: str) -> DataFrame:
    numbered = relational.number_within(bridge.samples(spark, d), ["source", "sample_group"], ["sample_id"], "replicate")
    return as_bigint(numbered.select("sample_id", "source", "sample_group", "replicate"), "replicate")


SAMPLES = [f"s{i}" for i in range(10)]


@query("fill_nulls", compose("select region_id, " + ", ".join(
    f"round(coalesce(max(case when sample_id = '{s}' and number_molecules >= 80 then frac_alpha_leq_25pct end), 0), 6) as {s}"
    for s in SAMPLES) + " from scores group by region_id"))
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    kept = inputs.scores(spark, d).withColumn(
        "score", F.when(F.col("number_molecules") >= 80, F.col(labels.SCORE_COLUMN)))
    return rounded(relational.wide(kept, "region_id", "sample_id", "score", SAMPLES).fillna(0.0), *SAMPLES)


# ---- regions ----------------------------------------------------------------
LIFTED = """select g.*, a.cpg_index_hg38 as region_cpg_index_min_hg38, b.cpg_index_hg38 as region_cpg_index_max_hg38
 from regions g left join cpg_map a on a.cpg_index = g.region_cpg_index_min
 left join cpg_map b on b.cpg_index = g.region_cpg_index_max"""
SPANS = ("region_cpg_index_max - region_cpg_index_min = region_cpg_index_max_hg38 - region_cpg_index_min_hg38 "
         "and region_cpg_index_max - region_cpg_index_min + 1 >= 3")


def _lifted(spark: SparkSession, d: str) -> DataFrame:
    return intervals.lift_over(bridge.regions(spark, d), bridge.cpg_map(spark, d),
                               ["region_cpg_index_min", "region_cpg_index_max"])


@query("liftover_regions", compose("select * from lifted", {"lifted": LIFTED}))
def liftover_regions(spark: SparkSession, d: str) -> DataFrame:
    return _lifted(spark, d)


@query("liftover_back", compose(
    "select l.region_id, l.region_cpg_index_min_hg38, m.cpg_index as region_cpg_index_min_hg38_hg19 from lifted l "
    "left join cpg_map m on m.cpg_index_hg38 = l.region_cpg_index_min_hg38", {"lifted": LIFTED}))
def liftover_back(spark: SparkSession, d: str) -> DataFrame:
    back = intervals.lift_over(_lifted(spark, d), bridge.cpg_map(spark, d), ["region_cpg_index_min_hg38"],
                               "cpg_index_hg38", "cpg_index", "_hg19")
    return back.select("region_id", "region_cpg_index_min_hg38", "region_cpg_index_min_hg38_hg19")


@query("region_geometry_filter", compose(
    f"select region_id, region_cpg_index_min_hg38 as region_cpg_index_min, region_cpg_index_max_hg38 as region_cpg_index_max "
    f"from lifted where {SPANS}", {"lifted": LIFTED}))
def region_geometry_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = intervals.region_geometry(_lifted(spark, d), min_cpg=3)
    return intervals.use_lifted_bounds(kept).select("region_id", "region_cpg_index_min", "region_cpg_index_max")


@query("liftover_report", compose(
    "select case when region_cpg_index_max_hg38 is null or region_cpg_index_min_hg38 is null then 'unmapped' "
    "when region_cpg_index_max - region_cpg_index_min <> region_cpg_index_max_hg38 - region_cpg_index_min_hg38 then 'span_changed' "
    "when region_cpg_index_max - region_cpg_index_min + 1 < 3 then 'too_short' else 'kept' end as outcome, count(*) as regions "
    "from lifted group by 1", {"lifted": LIFTED}))
def liftover_report(spark: SparkSession, d: str) -> DataFrame:
    return intervals.lift_report(_lifted(spark, d), min_cpg=3)


# The map with repeated indexes: the last line of an index counts, also where it has no target.
MAP_LINES = {
    "map_lines": "select cpg_index, cpg_index_hg38, 0 as line from cpg_map union all "
                 "select cpg_index, cpg_index + 1000, 1 from cpg_map where cpg_index % 7 < 3 union all "
                 "select cpg_index, null, 2 from cpg_map where cpg_index % 23 = 0",
    "map_last": "select cpg_index as i, cpg_index_hg38 as j from map_lines qualify line = max(line) over (partition by cpg_index)",
}


def _segments(spark: SparkSession, d: str) -> DataFrame:
    plain = bridge.cpg_map(spark, d).select("cpg_index", "cpg_index_hg38", F.lit(0).alias("line"))
    moved = plain.where("cpg_index % 7 < 3").select("cpg_index", F.col("cpg_index") + 1000, F.lit(1))
    lost = plain.where("cpg_index % 23 = 0").select("cpg_index", F.lit(None).cast("bigint"), F.lit(2))
    return intervals.index_segments(plain.union(moved).union(lost), order_by="line")


@query("index_segments", compose(
    "select min(i) as segment_start, max(i) as segment_end, shift as segment_shift from "
    "(select i, j - i as shift, i - row_number() over (partition by j - i order by i) as run from map_last where j is not null) "
    "group by shift, run", MAP_LINES))
def index_segments(spark: SparkSession, d: str) -> DataFrame:
    """The map with repeated indexes, as runs of one shift."""
    return _segments(spark, d)


@query("liftover_segments", compose(
    "select g.*, a.j as region_cpg_index_min_hg38, b.j as region_cpg_index_max_hg38 from regions g "
    "left join map_last a on a.i = g.region_cpg_index_min left join map_last b on b.i = g.region_cpg_index_max", MAP_LINES))
def liftover_segments(spark: SparkSession, d: str) -> DataFrame:
    return intervals.lift_over_segments(bridge.regions(spark, d), _segments(spark, d),
                                        ["region_cpg_index_min", "region_cpg_index_max"])


OVERLAP = "select molecule_id, sample_id, region_id, region_cpg_index_min, region_cpg_index_max from region_reads"


@query("overlap_join", compose(OVERLAP))
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlap_join(bridge.reads(spark, d), bridge.regions(spark, d))
    return pairs.select("molecule_id", "sample_id", "region_id", "region_cpg_index_min", "region_cpg_index_max")


@query("overlap_join_binned", compose(OVERLAP))
def overlap_join_binned(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlap_join(bridge.reads(spark, d), bridge.regions(spark, d), match_chr=True)
    return pairs.select("molecule_id", "sample_id", "region_id", "region_cpg_index_min", "region_cpg_index_max")


MARGINS = [0, 100, 1_000_000]


@query("overlap_join_levels", compose(
    "select g.region_id, r.sample_id, count(*) as pairs, min(r.cpg_index_min) as first_cpg, max(r.cpg_index_max) as last_cpg "
    "from reads r join wider g on r.cpg_index_min <= g.high and r.cpg_index_max >= g.low group by all", {
        "wider": "select region_id || '+' || margin as region_id, region_cpg_index_min - margin as low, region_cpg_index_max + margin as high "
                 f"from regions cross join (select unnest({MARGINS}) as margin)"}))
def overlap_join_levels(spark: SparkSession, d: str) -> DataFrame:
    """Regions as they are, 100 CpGs wider and a million wider on both sides, in one join."""
    margin = F.explode(F.array(*[F.lit(m).cast("bigint") for m in MARGINS]))
    wider = bridge.regions(spark, d).withColumn("_margin", margin).select(
        F.concat_ws("+", "region_id", "_margin").alias("region_id"),
        (F.col("region_cpg_index_min") - F.col("_margin")).alias("region_cpg_index_min"),
        (F.col("region_cpg_index_max") + F.col("_margin")).alias("region_cpg_index_max"))
    pairs = intervals.overlap_join_levels(bridge.reads(spark, d), wider)
    return pairs.groupBy("region_id", "sample_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("cpg_index_min").alias("first_cpg"), F.max("cpg_index_max").alias("last_cpg"))


# ---- joins ------------------------------------------------------------------
@query("scores_with_samples", compose(
    "select s.sample_id, region_id, ref_celltype, number_molecules from scores s join sample_map m using (sample_id)"))
def scores_with_samples(spark: SparkSession, d: str) -> DataFrame:
    return relational.label_join(inputs.scores(spark, d), "sample_id", inputs.sample_map(spark, d), "sample_id") \
        .select("sample_id", "region_id", "ref_celltype", "number_molecules")


@query("common_regions", compose(
    "select region_id from scores where number_molecules >= 70 group by region_id having count(distinct sample_id) = 10"))
def common_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions that all ten samples cover."""
    return relational.keys_in_all(relational.min_coverage(inputs.scores(spark, d), 70), "region_id", "sample_id", 10)


@query("donor_metadata", compose(
    "select distinct s.sample_id, sample_group, age, donor_sex as sex from samples s join donors d on d.sample_id = s.sample_id"))
def donor_metadata(spark: SparkSession, d: str) -> DataFrame:
    return relational.describe_samples(bridge.samples(spark, d), bridge.donors(spark, d))


# ---- counting and reshaping -------------------------------------------------
@query("total_reads", compose("select count(*) as rows, count(*) filter (where number_molecules = 1) as single from reads"))
def total_reads(spark: SparkSession, d: str) -> DataFrame:
    reads = bridge.reads(spark, d)
    return reads.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("number_molecules") == 1).alias("single"))


@query("region_coverage", compose("select region_id, count(*) as reads from region_reads group by region_id"))
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.region_read_coverage(inputs.region_reads(spark, d))


@query("sample_read_counts", compose("select sample_id, count(*) as reads from reads group by sample_id"))
def sample_read_counts(spark: SparkSession, d: str) -> DataFrame:
    return bridge.reads(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("reads")).orderBy("reads", "sample_id")


@query("sample_read_summary", compose(
    "select count(*) as n, sum(reads)::bigint as total, round(avg(reads), 6) as mean, round(stddev_samp(reads), 6) as sd, "
    "min(reads) as min, quantile_cont(reads, 0.25) as q1, quantile_cont(reads, 0.5) as median, "
    "quantile_cont(reads, 0.75) as q3, max(reads) as max from (select sample_id, count(*) as reads from reads group by 1) q"))
def sample_read_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = bridge.reads(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("reads"))
    return rounded(relational.count_summary(counts, "reads"), "mean", "sd")


@query("smallest_samples", compose(
    "select sample_id, count(*) as reads from reads group by sample_id order by reads, sample_id limit 6"))
def smallest_samples(spark: SparkSession, d: str) -> DataFrame:
    counts = bridge.reads(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("reads"))
    return relational.first_rows(counts, 6, "reads", "sample_id")


@query("distinct_samples", compose("select distinct sample_id from reads"))
def distinct_samples(spark: SparkSession, d: str) -> DataFrame:
    return bridge.reads(spark, d).select("sample_id").distinct()


@query("regions_per_celltype", compose("select ref_celltype, count(distinct region_id) as regions from region_map group by 1"))
def regions_per_celltype(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_per_group(inputs.region_map(spark, d), "ref_celltype", "region_id", "regions")


@query("group_sizes_none", compose(
    "select coalesce(cell_type, 'none') as cell_type, coalesce(sample_group, 'none') as sample_group, count(*) as rows from samples group by all"))
def group_sizes_none(spark: SparkSession, d: str) -> DataFrame:
    return relational.group_sizes(bridge.samples(spark, d), "cell_type", "sample_group")


@query("median_molecules", compose(
    "select region_id, quantile_cont(number_molecules, 0.5)::double as median from scores group by region_id"))
def median_molecules(spark: SparkSession, d: str) -> DataFrame:
    medians = relational.median_per_group(inputs.scores(spark, d), "region_id", "number_molecules")
    return medians.orderBy(F.desc("median"), "region_id")


@query("null_profile", compose(" union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls from samples"
    for c in ["sample_id", "source", "sample_group", "cell_type", "age"])))
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return relational.null_counts(bridge.samples(spark, d))


@query("null_cells_per_row", compose(
    "select sample_id, (cell_type is null)::bigint + (age is null)::bigint as nulls from samples"))
def null_cells_per_row(spark: SparkSession, d: str) -> DataFrame:
    return as_bigint(bridge.samples(spark, d).select(
        "sample_id", relational.nulls_per_row(bridge.samples(spark, d), ["cell_type", "age"]).alias("nulls")), "nulls")


AGES = ["0 - 20", "20 - 40", "40 - 60", "60 - 80"]


@query("value_counts_ordered", compose(
    "select age, count(*) as rows, list_position(['0 - 20', '20 - 40', '40 - 60', '60 - 80'], age) - 1::bigint as place "
    "from samples group by age"))
def value_counts_ordered(spark: SparkSession, d: str) -> DataFrame:
    return as_bigint(relational.value_counts(bridge.samples(spark, d), "age", AGES).orderBy("place"), "place")


HISTOGRAM = """select g.pool as cell_type, g.b as bin, round(lo + g.b * (hi - lo) / 20, 6) as bin_start,
 round(lo + (g.b + 1) * (hi - lo) / 20, 6) as bin_end,
 count(c.reads) as rows, any_value(g.median) as median
 from (select *, unnest(range(0, 20)) as b from (select pool, min(reads)::double as lo, max(reads)::double as hi,
       quantile_cont(reads, 0.5)::double as median from counts group by pool) l) g
 left join (select c.*, least(19, floor((reads - lo) / (hi - lo) * 20)) as b from counts c join (
       select pool, min(reads)::double as lo, max(reads)::double as hi from counts group by pool) l using (pool)) c
 on c.pool = g.pool and c.b = g.b group by all"""


@query("coverage_histogram", compose(HISTOGRAM, {
    "counts": "select pool, region_id, count(*) as reads from pools group by all"}))
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Reads per region, 20 bins and the median per cell type."""
    observed = scoring.observed_reads(scoring.trim_reads(inputs.pools(spark, d)))
    counts = materialize(intervals.region_read_coverage(observed, "cell_type"), "coverage")
    return as_bigint(rounded(relational.histogram(counts, "reads", 20, "cell_type"), "bin_start", "bin_end"), "rows")


@query("explode_molecules", compose(
    "select sample_id, count(*) as rows, sum(1)::bigint as molecules, max(copy)::bigint as last_copy from "
    "(select sample_id, unnest(range(0, number_molecules)) as copy from reads) q group by sample_id"))
def explode_molecules(spark: SparkSession, d: str) -> DataFrame:
    exploded = scoring.explode_molecules(bridge.reads(spark, d))
    return exploded.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("number_molecules").cast("bigint").alias("molecules"),
        F.max("copy_no").cast("bigint").alias("last_copy"))


@query("derived_seeds", compose(
    "select sample_id, ('0x' || substr(md5('888|' || sample_id), 1, 8))::bigint % 1000001 as seed from samples"))
def derived_seeds(spark: SparkSession, d: str) -> DataFrame:
    return bridge.samples(spark, d).select("sample_id", derived_seed(F.lit(888), F.col("sample_id")).alias("seed"))


# ---- scoring ----------------------------------------------------------------
@query("trim_pattern", compose("select molecule_id, region_id, t as trimmed_pat from trimmed"))
def trim_pattern(spark: SparkSession, d: str) -> DataFrame:
    return scoring.trim_reads(inputs.region_reads(spark, d)).select("molecule_id", "region_id", "trimmed_pat")


@query("kmer_counts", compose(f"select molecule_id, region_id, {', '.join(SUM_COLUMNS)} from counted"))
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = scoring.count_kmers(scoring.trim_reads(inputs.region_reads(spark, d)))
    return counted.select("molecule_id", "region_id", *SUM_COLUMNS)


@query("alpha_flags", compose(
    "select molecule_id, region_id, round(meth_k1::double / total_k1, 6) as alpha, "
    "frac_alpha_leq_25pct::bigint as frac_alpha_leq_25pct, frac_alpha_geq_75pct::bigint as frac_alpha_geq_75pct from scored"))
def alpha_flags(spark: SparkSession, d: str) -> DataFrame:
    observed = scoring.observed_reads(scoring.trim_reads(inputs.region_reads(spark, d)))
    flagged = scoring.flag_alpha(scoring.count_kmers(observed, kmers=(1,)))
    return rounded(flagged.select("molecule_id", "region_id", "alpha", *FLAGS), "alpha")


@query("score_region_sample", compose(f"select {SCORE_KEYS}{rounded_scores()} from scores"))
def score_region_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inputs.scores(spark, d), *FLAGS)


@query("score_rows_weighting", compose(
    f"select {SCORE_KEYS}{rounded_scores()} from row_scores",
    {"row_scores": f"select sample_id, region_id, {sums('1')} from scored group by all"}))
def score_rows_weighting(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.score_regions(inputs.region_reads(spark, d), ["sample_id"], weighting="rows"), *FLAGS)


@query("score_lifted", compose(
    f"select {SCORE_KEYS}{rounded_scores()} from lifted_scores", {
        "lifted": LIFTED,
        "lifted_reads": f"select r.*, l.region_id, l.region_cpg_index_min_hg38 as lo, l.region_cpg_index_max_hg38 as hi from reads r "
                        f"join lifted l on r.cpg_index_min <= l.region_cpg_index_max_hg38 and r.cpg_index_max >= l.region_cpg_index_min_hg38 where {SPANS}",
        "lifted_trimmed": "select *, substr(pat_string, greatest(lo - cpg_index_min, 0) + 1, least(hi, cpg_index_max) - cpg_index_min "
                          "- greatest(lo - cpg_index_min, 0) + 1) as t from lifted_reads",
        "lifted_counted": compose("select * from counted").split("counted as materialized (")[1].rsplit(" from trimmed)", 1)[0] + " from lifted_trimmed",
        "lifted_scored": "select *, (meth_k1::double / total_k1 <= 0.25)::int as frac_alpha_leq_25pct, "
                         "(meth_k1::double / total_k1 >= 0.75)::int as frac_alpha_geq_75pct from lifted_counted where total_k1 >= 3",
        "lifted_scores": f"select sample_id, region_id, {sums('number_molecules')} from lifted_scored group by all"}))
def score_lifted(spark: SparkSession, d: str) -> DataFrame:
    """Scores over regions lifted to the other assembly, unmapped and changed ones dropped."""
    kept = intervals.use_lifted_bounds(intervals.region_geometry(_lifted(spark, d), min_cpg=3))
    pairs = intervals.overlap_join(bridge.reads(spark, d), kept)
    return rounded(scoring.score_regions(pairs, ["sample_id"]), *FLAGS)


@query("score_pool_matrix", compose(
    "select region_id, any_value(immune) as immune, " + ", ".join(
        f"round(max(case when pool = '{g}' then frac_alpha_leq_25pct end), 6) as \"{g}\"" for g in bridge.GROUPS)
    + " from pool_scores group by region_id having count(*) = 5",
    {"pool_scores": f"select pool, region_id, case when contains(region_id, '1') or contains(region_id, '2') then 1::bigint else 0::bigint end "
                    f"as immune, {sums('number_molecules')} from pools group by all"}))
def score_pool_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Region scores of the whole pools side by side, for the regions all pools have, with a
    word indicator on the region id."""
    pool_scores = scoring.score_regions(inputs.pools(spark, d), ["cell_type"])
    matrix = relational.wide(pool_scores, "region_id", "cell_type", labels.SCORE_COLUMN, bridge.GROUPS).dropna()
    return as_bigint(rounded(matrix.withColumn("immune", relational.contains_any("region_id", ["1", "2"])), *bridge.GROUPS), "immune")
