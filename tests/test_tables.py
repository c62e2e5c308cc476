import pytest
from pyspark.sql import functions as F

from methmix import labels, schema
from methmix.operators import atlas, relational
from methmix.session import deal_single_file, fits_broadcast, materialize, scratch_path
from methmix.sources import tables


def test_duplicate_keys_are_refused(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        schema.assert_unique_keys(table, "k")
    assert schema.assert_unique_keys(table, "k", "v") is table


def test_malformed_reads_are_refused(spark):
    good = spark.createDataFrame([(1, 3, "CT.")], "cpg_index_min bigint, cpg_index_max bigint, pat_string string")
    assert schema.assert_valid_reads(good) is good
    with pytest.raises(ValueError):
        schema.assert_valid_reads(good.withColumn("cpg_index_max", F.lit(9)))


def test_tsv_columns_are_found_by_name(spark):
    path = scratch_path(spark, "t")
    frame = spark.createDataFrame([("r1", 5, 0.25), ("r2", None, None)], "region_id string, number_molecules bigint, extra double")
    tables.write_tsv(frame.select("extra", "number_molecules", "region_id"), path)
    back = tables.read_tsv(spark, path, schema.scores_schema(), ["region_id", "number_molecules"])
    assert sorted(map(tuple, back.collect())) == [("r1", 5), ("r2", None)]


@pytest.mark.parametrize("cell", ["abc", "7.5"])
def test_cells_that_do_not_fit_fail_the_read(spark, cell):
    path = scratch_path(spark, "t")
    tables.write_tsv(spark.createDataFrame([("r1", cell)], "region_id string, number_molecules string"), path)
    with pytest.raises(Exception, match="number_molecules"):
        tables.read_tsv(spark, path, schema.scores_schema(), ["region_id", "number_molecules"]).collect()
    path = scratch_path(spark, "bed")
    bed = spark.createDataFrame([("chr1", "10", "20", cell, "4", "r1")], "a string, b string, c string, d string, e string, f string")
    tables.write_tsv(bed, path, header=False, compression="none")
    with pytest.raises(Exception, match="region_cpg_index_min"):
        tables.read_bed(spark, path).collect()


def test_values_outside_the_order_are_counted(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("x",)], "v string")
    rows = {r["v"]: (r["rows"], r["place"]) for r in relational.value_counts(frame, "v", ["b", "a", "c"]).collect()}
    assert rows == {"a": (1, 1), "b": (2, 0), None: (1, None), "x": (1, None)}


def test_bed_reads_six_columns(spark):
    path = scratch_path(spark, "bed")
    rows = [("chr1", 10, 20, 1, 4, "r1", "x", 0.5)]
    frame = spark.createDataFrame(rows, "a string, b int, c int, d int, e int, f string, g string, h double")
    tables.write_tsv(frame, path, header=False, compression="none")
    assert [tuple(r) for r in tables.read_bed(spark, path).collect()] == [("chr1", 10, 20, 1, 4, "r1")]


def test_materialize_keeps_rows_and_order_of_columns(spark):
    frame = spark.createDataFrame([("x", 1), ("y", 2)], "cell_type string, n int").select("n", "cell_type")
    stored = materialize(frame, "m", "cell_type")
    assert sorted(map(tuple, stored.select("n", "cell_type").collect())) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("block, dealt", [(1 << 30, True), (1 << 14, False)])
def test_only_a_file_that_few_tasks_read_is_dealt(spark, block, dealt):
    """One file of 50,000 rows, as one row group and as many."""
    path = scratch_path(spark, "t")
    spark.range(0, 50_000, 1, 1).selectExpr("id", "md5(cast(id as string)) as v").write \
        .option("parquet.block.size", block).option("parquet.page.size", 1 << 12).parquet(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    try:
        table = deal_single_file(spark.read.parquet(path))
        assert ("RoundRobin" in table._jdf.queryExecution().executedPlan().toString()) == dealt
        assert table.selectExpr("count(*)", "sum(id)").first() == (50_000, 50_000 * 49_999 // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_broadcast_limits(spark):
    frame = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(frame) and not fits_broadcast(frame, max_rows=99) and not fits_broadcast(frame, max_bytes=50_000)


def test_labels(spark):
    frame = spark.createDataFrame([("Blueprint-CD4", None), ("Blueprint-B", "regulatory T cell"), (None, None)],
                                  "sample_group string, cell_type string")
    rows = frame.select(relational.relabel_where("cell_type", labels.T_SUBSET_CELL_TYPES, "sample_group").alias("a"),
                        relational.override("sample_group", labels.T_COMBINED_GROUPS).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("Blueprint-CD4", "Blueprint-T"), ("t_reg", "Blueprint-B"), (None, None)]


def test_region_with_two_targets_keeps_one_atlas_row(spark):
    matrix = spark.createDataFrame([("r1", 0.1), ("r2", 0.2)], "region_id string, x double")
    targets = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r2", "b")], "region_id string, ref_celltype string")
    rows = atlas.ordered_atlas(matrix, targets, ["a", "b"]).collect()
    assert [(r["region_id"], r["place"]) for r in rows] == [("r1", 0), ("r2", 1)]


def test_sets_and_reshaping(spark):
    frame = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r1", "a")], "k string, s string")
    assert [r["k"] for r in relational.keys_in_all(frame, "k", "s", 2).collect()] == ["r1"]
    other = spark.createDataFrame([("r1",)], "k string")
    assert [r["k"] for r in relational.keys_missing_from(frame, other, "k").collect()] == ["r2"]
    wide = relational.wide(frame.withColumn("v", F.lit(1.0)), "k", "s", "v", ["a", "b"])
    assert {tuple(r) for r in wide.collect()} == {("r1", 1.0, 1.0), ("r2", 1.0, None)}


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(5,), (5,)], "v int")
    rows = relational.histogram(frame, "v", 4).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [2, 0, 0, 0]


def test_null_counts_include_nan(spark):
    frame = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert {r["column"]: r["nulls"] for r in relational.null_counts(frame).collect()} == {"x": 2, "s": 1}
