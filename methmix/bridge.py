"""The methylation tables of this library, derived from the generic test tables.

One lineitem is one read, one part key block is one region, one supplier is one sample; call
strings come from an md5 of the line's key, poor in `C` inside the regions of the read's own
cell type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methmix.session import deal_single_file

# Order of the five groups in the derived tables.
GROUPS = ["Blueprint-B", "Blueprint-Mono", "Blueprint-Neutro", "Blueprint-T", "Blueprint-NK"]
TARGETS = ["Immune_Broad_B", "Immune_Broad_Dend_plus_Macro_plus_Mono", "Immune_Broad_Neutro",
           "Immune_Broad_CD4_plus_CD8", "Immune_Broad_NK"]
CELL_TYPES = ["immune_b", "immune_dend_plus_macro_plus_mono", "immune_neutro", "immune_t", "immune_nk"]
SHORT_NAMES = {"Blueprint-B": "B", "Blueprint-Mono": "Mono", "Blueprint-Neutro": "Neutro",
               "Blueprint-T": "T", "Blueprint-NK": "NK"}
# The T subsets in the order in which T reads are dealt to them, the detailed cell type of their samples and the
# panel target of their regions; then the seven pools with their reference cell types.
SUBSETS = ["t_naive", "t_reg", "t_effector"]
SUBSET_DETAILS = ["CD4-positive, alpha-beta T cell", "regulatory T cell", "effector memory CD8-positive, alpha-beta T cell"]
SUBSET_TARGETS = ["Immune_Lymph_CD4_plus_CD8_Naive_wo_CM", "Immune_Refined_CD4_Reg", "Immune_Lymph_CD4_plus_CD8_Activated_wo_CM"]
SUBSET_POOLS = ["Blueprint-B", "Blueprint-Mono", "Blueprint-Neutro", "t_naive", "t_reg", "t_effector", "Blueprint-NK"]
SUBSET_TYPES = ["immune_b", "immune_dend_plus_macro_plus_mono", "immune_neutro", "immune_t_naive", "immune_treg",
                "immune_t_effector", "immune_nk"]
LOCI = 200
BIG = "bigint"


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_t(group, number):
    """`group`, with the T group split by `number` into groups 10, 11 and 12."""
    return F.when(group == 3, number % 3 + 10).otherwise(group)


def reads(spark: SparkSession, sf_dir: str, subsets: bool = False) -> DataFrame:
    """Reads with the columns of `schema.READS`. With `subsets` every T sample is sorted into three samples, each poor in `C` in
    regions of its own."""
    lines = deal_single_file(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    locus = F.col("l_partkey") % LOCI
    sample = F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string"))
    group, target = F.col("l_suppkey") % 5, F.expr(f"((l_partkey % {LOCI}) div 5) % 5")
    if subsets:
        sample = F.when(group == 3, F.concat(sample, F.lit("-"), (F.col("l_orderkey") % 3).cast("string"))).otherwise(sample)
        group, target = _split_t(group, F.col("l_orderkey")), _split_t(target, F.expr(f"(l_partkey % {LOCI}) div 25"))
    staged = lines.select(
        sample.alias("sample_id"),
        key.alias("molecule_id"),
        F.concat(F.lit("chr"), F.expr(f"1 + (l_partkey % {LOCI}) div 50").cast("string")).alias("chr"),
        F.when(F.col("l_quantity") >= 45, 2).otherwise(1).cast("int").alias("number_molecules"),
        (locus * 5 + F.col("l_linenumber")).cast(BIG).alias("cpg_index_min"),
        group.alias("_group"),
        target.alias("_target"),
        (F.floor("l_quantity").cast("int") % 9 + 4).alias("_len"),
        F.md5(key).alias("_digest"))
    own = F.translate("_digest", "0123456789abcdef", "TTTTTTTTTTTTCCC.")
    other = F.translate("_digest", "0123456789abcdef", "CCCCCCCCCCCCTTT.")
    calls = F.when(F.col("_group") == F.col("_target"), own).otherwise(other)
    return staged.select(
        "sample_id", "molecule_id", "chr", "number_molecules", "cpg_index_min",
        (F.col("cpg_index_min") + F.col("_len") - 1).alias("cpg_index_max"),
        F.substring(calls, F.lit(1), F.col("_len")).alias("pat_string"))


def regions_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as a BED file holds them: the CpG end is exclusive."""
    blocks = (table(spark, sf_dir, "part")
              .select(F.expr(f"(p_partkey % {LOCI}) div 5").alias("r")).distinct())
    return blocks.select(
        F.concat(F.lit("chr"), F.expr("1 + r div 10").cast("string")).alias("region_chr"),
        (F.col("r") * 250 + 140).cast(BIG).alias("region_start"),
        (F.col("r") * 250 + 240).cast(BIG).alias("region_end"),
        (F.col("r") * 25 + 14).cast(BIG).alias("region_cpg_index_min"),
        (F.col("r") * 25 + 24).cast(BIG).alias("region_cpg_index_max"),
        F.concat(F.lit("r"), F.col("r").cast("string")).alias("region_id"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with closed bounds."""
    from methmix.operators.intervals import closed_regions
    return closed_regions(regions_bed(spark, sf_dir), end="exclusive")


def panel(spark: SparkSession, sf_dir: str, subsets: bool = False) -> DataFrame:
    """Panel entries; a region appears once per part that falls in its block. With `subsets` the T regions have T subsets as targets."""
    blocks = table(spark, sf_dir, "part").select(F.expr(f"(p_partkey % {LOCI}) div 5").alias("r"))
    target = _pick(TARGETS, F.col("r") % 5)
    if subsets:
        target = F.when(F.col("r") % 5 == 3, _pick(SUBSET_TARGETS, F.expr("(r div 5) % 3"))).otherwise(target)
    return blocks.select(
        F.concat(F.lit("r"), F.col("r").cast("string")).alias("region_id"),
        F.when(F.col("r") < 20, "immune_broad").otherwise("immune_refined").alias("subpanel"),
        target.alias("target_celltype"),
        F.when(F.col("r") % 13 == 12, 0).otherwise(1).cast("int").alias("v23_conv"))


def samples(spark: SparkSession, sf_dir: str, subsets: bool = False) -> DataFrame:
    """Sample metadata. The first ten suppliers are the samples of the reads; the others
    belong to another source. With `subsets` each T sample is three samples, one for each T subset."""
    key = F.col("s_suppkey")
    own = key < 10
    group = key % 5
    t_group = F.when(key % 10 == 3, "Blueprint-CD4").otherwise("Blueprint-CD8")
    cell_type = (F.when(group != 3, F.lit(None).cast("string"))
                 .when(key % 10 == 3, "regulatory T cell")
                 .otherwise("CD4-positive, alpha-beta T cell"))
    age = F.when(F.col("s_acctbal") < 0, None).otherwise(
        F.concat((F.floor(F.col("s_acctbal") / 2500) * 20).cast("bigint").cast("string"), F.lit(" - "),
                 (F.floor(F.col("s_acctbal") / 2500) * 20 + 20).cast("bigint").cast("string")))
    found = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("sample_id"),
        F.when(own, "blueprint_loyfer2022").otherwise("other").alias("source"),
        F.when(group == 3, t_group).otherwise(_pick(GROUPS, group)).alias("sample_group"),
        cell_type.alias("cell_type"), age.alias("age"))
    if not subsets:
        return found
    t_samples = found.where(F.col("cell_type").isNotNull()).withColumn("_subset", F.explode(F.sequence(F.lit(0), F.lit(2))))
    sorted_samples = t_samples.withColumns({
        "sample_id": F.concat("sample_id", F.lit("-"), F.col("_subset").cast("string")),
        "cell_type": _pick(SUBSET_DETAILS, F.col("_subset"))}).drop("_subset")
    return found.where(F.col("cell_type").isNull()).unionByName(sorted_samples)


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor metadata, two rows per known sample; every seventh sample is unknown."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(key % 7 != 4).select(
        F.concat(F.lit("s"), key.cast("string")).alias("SAMPLE_ID"),
        F.when(F.col("s_nationkey") % 2 == 0, "Female").otherwise("Male").alias("DONOR_SEX"),
        _pick(GROUPS, key % 5).alias("CELL_TYPE"),
        F.explode(F.array(F.lit("file1"), F.lit("file2"))).alias("FILE"))


def cpg_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CpG positions covered by reads. Every 19th is unmapped in the other assembly, and
    the shift grows by one every 40."""
    covered = (reads(spark, sf_dir).select("chr", "cpg_index_min", "cpg_index_max").distinct()
               .select(F.explode(F.sequence("cpg_index_min", "cpg_index_max")).alias("i")).distinct())
    return covered.select(
        F.lit("chr1").alias("chr"), (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 2).alias("end"),
        F.col("i").alias("cpg_index"),
        F.when(F.col("i") % 19 == 0, None).otherwise(F.col("i") + F.expr("i div 40"))
        .cast(BIG).alias("cpg_index_hg38"))
