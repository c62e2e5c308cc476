import math
import pathlib
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from methmix.functions import hashing
from methmix.operators import design, mixing
from methmix.plans import pipelines

POOL_ROWS = {"big": 6000, "small": 1500}


@pytest.fixture(scope="module")
def pools(spark):
    rows = [(f"{c}{i}", f"r{i % 5}", c, 1 + i % 2) for c, n in POOL_ROWS.items() for i in range(n)]
    table = spark.createDataFrame(rows, "molecule_id string, region_id string, cell_type string, number_molecules int")
    return mixing.keyed_pools(table, ["molecule_id", "region_id"]).cache()


def fractions(spark, values, replicates=4):
    rows = [("t", p, r, c, float(f)) for p, by_type in enumerate(values) for r in range(replicates)
            for c, f in by_type.items()]
    return spark.createDataFrame(rows, "titrated string, proportion_id int, replicate int, cell_type string, fraction double")


def counts(drawn):
    return {(r["proportion_id"], r["replicate"], r["cell_type"]): r["drawn"] for r in mixing.realised_counts(drawn).collect()}


def test_counts_are_within_five_sigma(spark, pools):
    values = [{"big": 0.05, "small": 0.5}, {"big": 0.3, "small": 0.0}]
    drawn = counts(mixing.mix(pools, fractions(spark, values), 888))
    for p, by_type in enumerate(values):
        for r in range(4):
            for c, f in by_type.items():
                n = POOL_ROWS[c]
                assert abs(drawn.get((p, r, c), 0) - n * f) <= 5 * math.sqrt(n * f * (1 - f))


def test_edge_fractions(spark, pools):
    drawn = counts(mixing.mix(pools, fractions(spark, [{"big": 1.0, "small": 0.0}], 2), 1))
    assert drawn == {(0, 0, "big"): 6000, (0, 1, "big"): 6000}


def test_over_sampling_is_poisson(spark, pools):
    drawn = mixing.mix(pools, fractions(spark, [{"big": 2.5, "small": 1.2}], 1), 3)
    per_row = drawn.groupBy("cell_type", "molecule_id").count()
    sums = {r["cell_type"]: (r["n"], r["s"]) for r in per_row.groupBy("cell_type").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") ** 2).alias("s")).collect()}
    for c, f in (("big", 2.5), ("small", 1.2)):
        n = POOL_ROWS[c]
        assert abs(sums[c][0] - n * f) <= 5 * math.sqrt(n * f)
        second = sums[c][1] / n  # mean of squares is f + f^2
        assert abs(second - (f + f * f)) < 0.15 * (f + f * f)


def test_draws_do_not_depend_on_partitioning(spark, pools):
    plan = fractions(spark, [{"big": 0.02, "small": 0.2}], 2)
    key = ["molecule_id", "replicate", "proportion_id"]
    one = sorted(mixing.mix(pools.coalesce(1), plan, 5).select(*key).collect())
    many = sorted(mixing.mix(pools.repartition(7), plan, 5).select(*key).collect())
    assert one == many
    other_seed = sorted(mixing.mix(pools, plan, 6).select(*key).collect())
    assert one != other_seed


def test_salted_join_draws_the_same_rows(spark, pools, monkeypatch):
    plan = fractions(spark, [{"big": 0.02, "small": 1.4}], 2)
    key = ["molecule_id", "replicate", "copy_no"]
    small = sorted(mixing.mix(pools, plan, 5).select(*key).collect())
    monkeypatch.setattr(mixing, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(mixing, "ROWS_PER_SALT", 500)
    large = sorted(mixing.mix(pools, plan, 5).select(*key).collect())
    assert small == large


def test_mixtures_are_independent(spark, pools):
    """Two mixtures of the same fraction share about fraction^2 of the rows."""
    drawn = mixing.mix(pools, fractions(spark, [{"big": 0.3}], 2), 9)
    both = drawn.groupBy("molecule_id").count().where("count = 2").count()
    n, p = POOL_ROWS["big"], 0.09
    assert abs(both - n * p) <= 5 * math.sqrt(n * p * (1 - p))


def test_thresholds_add_up_to_the_fraction(spark):
    table = mixing.copy_thresholds(fractions(spark, [{"big": 4.2, "small": 0.7}], 1))
    sums = {r["cell_type"]: r["s"] for r in table.groupBy("cell_type").agg(F.sum("threshold").alias("s")).collect()}
    assert sums["big"] == pytest.approx(4.2, abs=1e-9) and sums["small"] == 0.7


def test_mixture_does_not_depend_on_the_rest_of_the_design(spark, pools):
    """The same rows alone and beside other mixtures and cell types; other rows under another seed."""
    key = ["molecule_id", "seed"]
    alone = sorted(mixing.mix(pools, fractions(spark, [{"big": 0.1}], 1), 5).select(*key).collect())
    beside = mixing.mix(pools, fractions(spark, [{"big": 0.1, "small": 0.5}, {"big": 0.4}], 3), 5)
    assert alone == sorted(beside.where("cell_type = 'big' and proportion_id = 0 and replicate = 0").select(*key).collect())
    own = fractions(spark, [{"big": 0.1}], 1)
    one = sorted(mixing.mix(pools, own.withColumn("seed", F.lit(1)), 5).select("molecule_id").collect())
    two = sorted(mixing.mix(pools, own.withColumn("seed", F.lit(2)), 5).select("molecule_id").collect())
    assert one != two and alone


def test_sparse_mixtures_are_drawn_by_their_fractions(spark, pools, monkeypatch):
    """Many small fractions, up to the largest sparse one and in several cells, each with its own count and none twice."""
    monkeypatch.setattr(mixing, "SPARSE", 0.125)
    values = [{"big": f, "small": 0.125} for f in (0.125, 0.1, 0.0, 1e-3, 0.02, 0.12, 0.11, 0.125)]
    drawn = mixing.mix(pools, fractions(spark, values, 6), 4).cache()
    assert drawn.groupBy("proportion_id", "replicate", "molecule_id").count().where("count > 1").isEmpty()
    found = counts(drawn)
    for p, by_type in enumerate(values):
        for c, f in by_type.items():
            n, all_ = POOL_ROWS[c] * 6, sum(found.get((p, r, c), 0) for r in range(6))
            assert abs(all_ - n * f) <= 4.5 * math.sqrt(n * f * (1 - f))
    # Neighbours in a cell, and replicates, share as many rows as independent draws do.
    for left, right in ((("proportion_id", 0), ("proportion_id", 1)), (("proportion_id", 5), ("proportion_id", 6)), (("replicate", 0), ("replicate", 1))):
        other = "replicate" if left[0] == "proportion_id" else "proportion_id"
        a, b = (drawn.where((F.col(name) == value) & (F.col("cell_type") == "big")).select("molecule_id", other) for name, value in (left, right))
        expected = (6 * 6000 * values[left[1]]["big"] * values[right[1]]["big"] if other == "replicate"
                    else sum(6000 * v["big"] ** 2 for v in values))
        assert abs(a.join(b, ["molecule_id", other]).count() - expected) <= 5 * math.sqrt(expected)
    drawn.unpersist()


def test_sparse_mixtures_do_not_depend_on_other_experiments(spark, pools, monkeypatch):
    """Further titrated types and dense mixtures leave the rows of the others alone."""
    monkeypatch.setattr(mixing, "SPARSE", 0.125)
    key = ["molecule_id", "titrated", "proportion_id", "replicate"]
    small = fractions(spark, [{"big": 0.1}, {"big": 0.05}], 2)
    more = (fractions(spark, [{"big": 0.1, "small": 0.1}, {"big": 0.05}, {"big": 0.6}], 2)
            .unionByName(small.withColumn("titrated", F.lit("a"))))
    beside = mixing.mix(pools, more, 5).where("titrated = 't' and cell_type = 'big' and proportion_id < 2")
    assert sorted(mixing.mix(pools, small, 5).select(*key).collect()) == sorted(beside.select(*key).collect())


def test_work_follows_the_rows_drawn(spark, pools, monkeypatch):
    """Of 400 sparse mixtures, rows meet cells, and what comes out of the joins is about what is drawn."""
    monkeypatch.setattr(mixing, "SPARSE", 1 / 32)
    plan_rows = fractions(spark, [{"big": 0.002 * (1 + p % 3), "small": 0.001} for p in range(20)], 20)
    plan = mixing.mixture_plan(plan_rows, 3)
    assert plan.dense is None and plan.cells.count() == 5
    met = mixing._meet(pools, plan.cells).where(mixing.hashing.draw() < F.col("limit_1")).count()
    drawn = mixing._draws(pools, plan)[0].count()
    expected = 20 * sum(POOL_ROWS["big"] * 0.002 * (1 + p % 3) + POOL_ROWS["small"] * 0.001 for p in range(20))
    assert abs(drawn - expected) <= 5 * math.sqrt(expected) and met <= drawn
    assert plan.intervals.count() <= 2 * 20 * 20 + 5 * 64


def test_seeds_of_a_cell(spark, pools, monkeypatch):
    """A new seed draws other rows, also for the sparse neighbours in the cell."""
    monkeypatch.setattr(mixing, "SPARSE", 0.125)
    plan = fractions(spark, [{"big": 0.1}, {"big": 0.1}], 1)
    one = mixing.mix(pools, plan.withColumn("seed", F.lit(1)), 5)
    two = mixing.mix(pools, plan.withColumn("seed", F.col("proportion_id") + 1), 5)
    for p in (0, 1):
        assert sorted(one.where(f"proportion_id = {p}").select("molecule_id").collect()) != sorted(
            two.where(f"proportion_id = {p}").select("molecule_id").collect())


def test_empty_designs(spark, pools):
    none = fractions(spark, [{"big": 0.0}], 2)
    assert mixing.mix(pools, none, 5).columns and mixing.mix(pools, none, 5).isEmpty()


def test_total_reads_by_key_or_in_one_row(spark):
    plan = spark.createDataFrame([("a", "big", 0.5), ("b", "big", 0.5)], "titrated string, cell_type string, proportion double")
    sizes = spark.createDataFrame([("big", 100)], "cell_type string, pool_rows bigint")
    one = spark.createDataFrame([(40,)], "total_reads bigint")
    assert {r["fraction"] for r in mixing.sampling_fractions(plan, sizes, one).collect()} == {0.2}
    by_key = spark.createDataFrame([("a", 40), ("b", 80)], "titrated string, total_reads bigint")
    assert {(r["titrated"], r["fraction"]) for r in mixing.sampling_fractions(plan, sizes, by_key).collect()} == {("a", 0.2), ("b", 0.4)}
    for wrong in (one.union(one), one.limit(0), by_key.union(by_key), by_key.withColumnRenamed("titrated", "other")):
        with pytest.raises(ValueError):
            mixing.sampling_fractions(plan, sizes, wrong)


def test_native_sampler(spark, pools):
    drawn = mixing.mix_native(pools, {"big": 0.5, "small": 1.5}, 2).groupBy("cell_type").count().collect()
    n = {r["cell_type"]: r["count"] for r in drawn}
    assert abs(n["big"] - 3000) < 300 and abs(n["small"] - 2250) < 300


# ---- designs ----------------------------------------------------------------
BLOOD = {"B": 0.06, "Mono": 0.09, "Neutro": 0.57, "T": 0.23, "NK": 0.05}


@pytest.fixture(scope="module")
def abundance(spark):
    return spark.createDataFrame(list(BLOOD.items()), "cell_type string, abundance double")


def shares(df, proportion_id=0):
    return {r["cell_type"]: r["proportion"] for r in df.where(F.col("proportion_id") == proportion_id).collect()}


def test_uniform_background(abundance):
    got = shares(design.uniform_background(abundance, ["B"], [0.2]))
    assert all(v == pytest.approx(0.2) for v in got.values()) and len(got) == 5


def test_custom_background(abundance):
    got = shares(design.custom_background(abundance, ["B"], [0.2]))
    assert got["Neutro"] == pytest.approx(0.57 / 0.94 * 0.8) and sum(got.values()) == pytest.approx(1)
    combined = design.combined_truth(design.custom_background(abundance, ["B"], [0.2]), {"T": "lymph", "NK": "lymph"})
    total = {r["ref_celltype"]: r["true_proportion"] for r in combined.collect()}
    assert total["lymph"] == pytest.approx(got["T"] + got["NK"])


def test_two_level_background(spark):
    rows = [("t_reg", 0.2, True), ("t_effector", 0.2, True), ("t_naive", 0.8, True), ("B", 0.06, False), ("Neutro", 0.57, False)]
    table = spark.createDataFrame(rows, "cell_type string, abundance double, in_group boolean")
    got = shares(design.two_level_background(table, ["t_reg"], [0.1], 0.23))
    assert got["t_reg"] == pytest.approx(0.023)
    assert got["t_effector"] == pytest.approx(0.23 * 0.9 * 0.2) and got["t_naive"] == pytest.approx(0.23 * 0.9 * 0.8)
    assert got["B"] == 0.06 and got["Neutro"] == 0.57


def test_proportions_must_add_up_to_one(abundance):
    whole = design.custom_background(abundance, ["B", "T"], [0.2, 0.0])
    assert design.complete(whole) is whole
    with pytest.raises(ValueError):
        design.complete(whole.where("cell_type <> 'NK'"))


def test_labels(spark):
    rows = [("B", "B", 0, 0.05), ("B", "CD4", 0, 0.015), ("B", "CD8", 0, 0.5), ("B", "Mono", 0, 0.0)]
    table = spark.createDataFrame(rows, "titrated string, cell_type string, proportion_id int, proportion double")
    names = {n: n for n in ("B", "CD4", "CD8", "Mono")}
    assert design.mixture_labels(table, names, ["CD4", "CD8", "Mono", "B"]).first()["label"] == "E05B_E015CD4_E5CD8_EMONO"


def test_every_replicate_has_a_seed_of_its_own(abundance):
    table = design.replicate(design.custom_background(abundance, ["B", "T"], [0.2, 0.1, 0.0]), 20, 888)
    seeds = table.select("titrated", "proportion_id", "replicate", "seed").distinct()
    assert seeds.count() == 2 * 3 * 20  # more replicates than levels is fine
    assert seeds.agg(F.max("seed")).first()[0] <= 1_000_000


TREE = [("naive", None, "b", 1.0), ("naive", None, "lymphoid", 3.0),
        ("naive", "lymphoid", "nk", 0.2), ("naive", "lymphoid", "t", 0.8),
        ("naive", "t", "naive", 0.0), ("naive", "t", "effector", 0.5), ("naive", "t", "reg", 1.5),
        ("nk", None, "b", 0.5), ("nk", None, "lymphoid", 0.5),
        ("nk", "lymphoid", "nk", 9.0), ("nk", "lymphoid", "t", 1.0), ("nk", "t", "naive", 1.0), ("nk", "t", "reg", 3.0)]


def tree(spark, rows):
    return spark.createDataFrame(rows, "titrated string, parent string, node string, share double")


def test_tree_background_at_any_depth(spark):
    found = design.complete(design.tree_background(tree(spark, TREE), [0.2, 0.0, 1.0])).collect()
    got = {(r["titrated"], r["titration"], r["cell_type"]): r["proportion"] for r in found}
    assert len(got) == len(found) == 3 * (5 + 4)
    part_of_t = 0.75 * 0.8  # the path to the T cells does not depend on the level
    assert got["naive", 0.2, "naive"] == pytest.approx(part_of_t * 0.2)
    assert got["naive", 0.2, "reg"] == pytest.approx(part_of_t * 0.8 * 0.75)
    assert got["naive", 1.0, "effector"] == 0
    assert [got["naive", level, "nk"] for level in (0.2, 0.0, 1.0)] == pytest.approx([0.15] * 3)
    # A sibling of the titrated leaf hands its rest on to what lies below it.
    assert got["nk", 0.2, "nk"] == pytest.approx(0.5 * 0.2)
    assert got["nk", 0.2, "reg"] == pytest.approx(0.5 * 0.8 * 0.75)
    assert got["nk", 0.0, "naive"] == pytest.approx(0.5 * 0.25)


def test_tree_of_two_levels_is_the_two_level_background(spark):
    table = spark.createDataFrame([("b", 0.77, False), ("t_naive", 0.9, True), ("t_reg", 0.1, True), ("t_eff", 0.0, True)],
                                  "cell_type string, abundance double, in_group boolean")
    nested = tree(spark, [("t_eff", None, "b", 0.77), ("t_eff", None, "t", 0.23), ("t_eff", "t", "t_naive", 0.9),
                          ("t_eff", "t", "t_reg", 0.1), ("t_eff", "t", "t_eff", 0.0)])
    levels = [0.3, 0.01]
    two = {(r["cell_type"], r["titration"]): r["proportion"]
           for r in design.two_level_background(table, ["t_eff"], levels, 0.23).collect()}
    deep = {(r["cell_type"], r["titration"]): r["proportion"] for r in design.tree_background(nested, levels).collect()}
    assert deep == pytest.approx(two)


@pytest.mark.parametrize("rows, fault", [
    ([("a", None, "a", 0.0), ("a", None, "b", None)], "null or negative share"),
    ([("a", None, "a", 0.0), ("a", None, "b", -1.0)], "null or negative share"),
    ([("a", None, "a", 0.0), ("a", None, None, 1.0)], "null name"),
    ([("a", None, "a", 0.0), ("a", None, "b", 1.0), ("a", "b", "b", 1.0)], "a node twice"),
    ([("a", None, "a", 0.0), ("a", None, "b", 0.0)], "siblings without a share"),
    ([("a", None, "b", 1.0)], "no leaf"),
    ([("a", None, "a", 0.0), ("a", None, "b", 1.0), ("a", "a", "c", 1.0)], "nodes below"),
    ([("a", None, "a", 0.0), ("a", None, "b", 1.0), ("a", "nobody", "c", 1.0)], "no path from c"),
    ([("a", None, "a", 0.0), ("a", None, "b", 1.0), ("a", "d", "c", 1.0), ("a", "c", "d", 1.0)], "no path from"),
])
def test_wrong_trees(spark, rows, fault):
    with pytest.raises(ValueError, match=fault):
        design.tree_background(tree(spark, rows), [0.1])


def test_empty_tree(spark):
    assert design.tree_background(tree(spark, []), [0.1]).collect() == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_pool_pieces_follow_the_counts(spark, monkeypatch, broadcast):
    """57 % of the rows in one type, most of them in one region; a type and a region without a name."""
    if not broadcast:
        monkeypatch.setattr(pipelines, "broadcast_if_small", lambda df: df)
    shares = {"hot": 0.57, "b": 0.2, "c": 0.12, "d": 0.1, None: 0.01}
    rows = [(f"{c}{i}", (None if i % 50 == 1 else "r0" if c == "hot" and i % 4 else f"r{i * 7 % 200}"), c)
            for c, share in shares.items() for i in range(int(20_000 * share))]
    table = mixing.keyed_pools(spark.createDataFrame(rows, "molecule_id string, region_id string, cell_type string"), ["molecule_id"])
    for most, pieces in [(10 ** 9, 16), (400, 50)]:
        dealt = pipelines.dealt_by_counts(table, most).withColumn("piece", F.spark_partition_id())
        assert sorted(dealt.columns) == sorted([*table.columns, "piece"])
        seen = dealt.collect()
        assert sorted((r["molecule_id"], str(r["region_id"]), str(r["cell_type"]), r["row_y"]) for r in seen) == sorted(
            (r["molecule_id"], str(r["region_id"]), str(r["cell_type"]), r["row_y"]) for r in table.collect())
        by_piece = {}
        for r in seen:
            by_piece.setdefault(r["piece"], []).append(r)
        sizes = sorted(map(len, by_piece.values()))
        assert pieces <= len(sizes) <= pieces + len(shares) and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert all(len({r["cell_type"] for r in piece}) == 1 for piece in by_piece.values())
    hot = [len({r["region_id"] for r in piece}) for piece in by_piece.values() if piece[0]["cell_type"] == "hot"]
    assert sorted(hot)[len(hot) // 2] == 1  # the crowded region has pieces of its own
    assert pipelines.dealt_by_counts(table.where("false")).collect() == []


@pytest.fixture(scope="module")
def scored(spark):
    """Small scored pools with dense and sparse mixtures: two types, three regions."""
    rows = [(f"m{c}{i}", "s0", c, f"r{i % 3}", "chr1", 1 + i % 2, i, i + 5, "CCTTCT" if i % 4 else "CCCCCC", 0, 10)
            for c, n in POOL_ROWS.items() for i in range(n)]
    table = spark.createDataFrame(rows, "molecule_id string, sample_id string, cell_type string, region_id string, chr string, number_molecules int, "
                                        "cpg_index_min bigint, cpg_index_max bigint, pat_string string, region_cpg_index_min bigint, region_cpg_index_max bigint")
    stored = pipelines.scored_pools(table)
    return stored, stored.groupBy("cell_type").agg(F.count(F.lit(1)).alias("pool_rows"))


def titration(spark, replicates, shares=(0.0, 0.001, 0.5)):
    rows = [("big", p, r, c, s if c == "big" else 1 - s, 100 + r) for p, s in enumerate(shares) for r in range(replicates) for c in POOL_ROWS]
    return spark.createDataFrame(rows, "titrated string, proportion_id int, replicate int, cell_type string, proportion double, seed bigint")


def lines(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def folders(path):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("part-*.parquet")}


def test_a_stopped_experiment_goes_on(spark, scored, tmp_path):
    pools, counts = scored
    plan, path = titration(spark, 3), str(tmp_path / "e")
    whole = lines(pipelines.mixture_scores(pools, counts, plan, 0.2))
    first = pipelines.continue_experiment(pools, counts, plan, 0.2, path, steps=3, most_steps=1)
    assert 0 < len(lines(first)) < len(whole) and set(lines(first)) <= set(whole)
    # a pass that breaks off after its scores and before its list leaves folders, which the next run replaces
    shutil.copytree(path + "/finished", path + "/before")
    broken = pipelines.continue_experiment(pools, counts, plan, 0.2, path, steps=3, most_steps=1)
    broken_lines = lines(broken)
    shutil.rmtree(path + "/finished")
    shutil.copytree(path + "/before", path + "/finished")
    assert lines(pipelines.continue_experiment(pools, counts, plan, 0.2, path, steps=3)) == whole
    assert set(broken_lines) <= set(whole)
    files = folders(path)
    assert lines(pipelines.continue_experiment(pools, counts, plan, 0.2, path, steps=3)) == whole and folders(path) == files
    assert spark.read.parquet(path + "/finished").count() == 9


def test_an_added_replicate_scores_its_own_mixtures(spark, scored, tmp_path, monkeypatch):
    pools, counts = scored
    path = str(tmp_path / "e")
    before = lines(pipelines.continue_experiment(pools, counts, titration(spark, 2), 0.2, path))
    files, seen, only = folders(path + "/scores"), [], mixing.only_mixtures

    def watched(plan, keys):
        part = only(plan, keys)
        for table in (part.dense, part.intervals):
            if table is not None:
                seen.extend(r[0] for r in table.join(part.names, "mixture_no", "left").select("replicate").collect())
        return part

    monkeypatch.setattr(mixing, "only_mixtures", watched)
    after = pipelines.continue_experiment(pools, counts, titration(spark, 3), 0.2, path)
    assert set(seen) == {2}  # no draws but those of the new replicate
    assert lines(after.where("replicate < 2")) == before and after.where("replicate = 2").count() > 0
    assert files.items() <= folders(path + "/scores").items()


def test_an_experiment_without_mixtures(spark, scored, tmp_path):
    pools, counts = scored
    none = pipelines.continue_experiment(pools, counts, titration(spark, 0), 0.2, str(tmp_path / "e"))
    assert none.collect() == []


def test_totals_are_sums_of_the_drawn_rows(spark, pools):
    """Dense and sparse mixtures, several copies, null values and cell types."""
    nulls = pools.where("row_x % 9 < 3").unionByName(pools.withColumn("cell_type", F.lit(None).cast("string")).limit(5)).select(
        "cell_type", "row_x", "row_y", "region_id", F.when(F.col("region_id") != "r3", F.col("number_molecules")).alias("n"),
        F.when(F.col("row_y") % 3 == 0, F.col("row_y") * (1 << 20)).alias("wide")).cache()
    plan = fractions(spark, [{"big": 0.3, "small": 2.5}, {"big": 0.002, "small": 1.0}, {"big": 3.7, "small": 0.01}], 3)
    keys = [*mixing.MIXTURE_KEYS, "seed", "cell_type"]
    rows = mixing.mix(nulls, plan, 5).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("drawn"), F.max("copy_no").cast("bigint").alias("most_copies"), F.sum("n").alias("n"), F.sum("wide").alias("wide"))
    totals = mixing.mix_totals(nulls, plan, 5, ["n", "wide"])
    assert sorted(totals.select(rows.columns).collect()) == sorted(rows.collect())
    assert sorted(mixing.realised_counts(totals).collect()) == sorted(mixing.realised_counts(mixing.mix(nulls, plan, 5)).collect())
    numbered = mixing.mixture_plan(plan, 5)
    values = {"n": F.col("n"), "wide": F.col("wide")}
    sums = {(r["mixture_no"], r["region_id"]): r[2:] for r in mixing._summed(nulls, numbered, "region_id", values).collect()}
    parts = [part.select("mixture_no", "region_id", "n", "wide", "copy_no") for part in mixing._draws(nulls, numbered)]
    drawn = parts[0].unionByName(parts[1]).groupBy("mixture_no", "region_id").agg(
        F.count(F.lit(1)), F.max("copy_no").cast("bigint"), F.sum("n"), F.sum("wide"))
    assert sums == {(r[0], r[1]): r[2:] for r in drawn.collect()}
    assert any(v[2] is None for v in sums.values())
    nulls.unpersist()


@pytest.mark.parametrize("pairs, mixtures, held", [(1 << 16, 512, 1 << 22), (64, 3, 1), (8, 1, 40)])
def test_blocks_of_draws(pairs, mixtures, held):
    """Blocks smaller than a group's rows and mixtures; largest and smallest words and limits."""
    rows = [("a" if i % 7 else None, x, y, i % 3, None if i % 4 == 1 else i) for i, (x, y) in enumerate(
        (x, y) for x in (0, 1, 5, 2 ** 27 + 3, 2 ** 28 - 1) for y in (0, 2, 77777, 2 ** 28 - 1))]
    words = [(1, 1, 0), (2 ** 28, 2 ** 28, 2 ** 28 - 1), (12345, 2 ** 27, 99), (2 ** 28, 3, 7), (8, 1, mixing.hashing.PRIME // 16)]
    prime = mixing.hashing.PRIME
    draws = [("a", m, n + 1, *w, limit) for m, w in enumerate(words) for n, limit in enumerate((float(prime), 0.5 * prime + 0.5, 1.0)[:m + 1])]
    table = mixing.blocks.pa.Table.from_pylist([dict(zip(("cell_type", "mixture_no", "copy_no", "mix_a", "mix_b", "mix_c", "limit"), d)) for d in draws])
    names, pa = ["cell_type", "row_x", "row_y", "g", "v"], mixing.blocks.pa
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in part], pa.schema([("cell_type", pa.string())] + [(n, pa.int64()) for n in names[1:]]))
               for part in (rows[:9], [], rows[9:])]
    schema = pa.schema([(n, pa.int64()) for n in ("mixture_no", "g", "drawn", "most_copies", "v")])
    found, wanted = {}, {}
    for batch in mixing.blocks.summed_draws(iter(batches), mixing.blocks.draws_by_type(table), schema, pairs, mixtures, held):
        for r in batch.to_pylist():
            own = found.setdefault((r["mixture_no"], r["g"]), [0, 0, []])
            own[0], own[1] = own[0] + r["drawn"], max(own[1], r["most_copies"])
            own[2].append(r["v"])
    for cell_type, x, y, g, v in rows:
        for own_type, m, copy, a, b, c, limit in draws:
            if cell_type == own_type and (a * x + b * y + c) % prime < limit:
                own = wanted.setdefault((m, g), [0, 0, []])
                own[0], own[1] = own[0] + 1, max(own[1], copy)
                own[2].append(v)
    total = {k: (n, most, sum(v for v in vs if v is not None), all(v is None for v in vs)) for k, (n, most, vs) in found.items()}
    assert total == {k: (n, most, sum(v for v in vs if v is not None), all(v is None for v in vs)) for k, (n, most, vs) in wanted.items()}


def test_sums_of_drawn_rows_do_not_join_rows_with_mixtures(spark, pools):
    """Dense mixtures are drawn in the tasks that sum them; a joined plan made a row of every (pool row, mixture) pair."""
    scored = pools
    for name in mixing.scoring.score_columns():
        scored = scored.withColumn(name, F.lit(1).cast("bigint"))
    sums = mixing.mix_scores(scored, fractions(spark, [{"big": 0.5, "small": 0.5}]), 5)
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "limit" not in text


def test_values_beyond_the_sums_are_an_error(spark, pools):
    huge = pools.withColumn("n", F.lit(2 ** 61))
    with pytest.raises(Exception, match="too large"):
        mixing.mix_totals(huge, fractions(spark, [{"big": 0.5}]), 5, ["n"]).collect()


def test_block_draws_are_the_draws_of_rows():
    """One product gives every draw to the step, with the largest and smallest words as well."""
    rng, top, prime = np.random.default_rng(5), (1 << 28) - 1, hashing.PRIME
    x, y = (np.r_[0, top, 0, top, rng.integers(0, top + 1, 2000)] for _ in range(2))
    a, b, c = (np.r_[least, most, least, most, rng.integers(least, most + 1, 500)] for least, most in ((1, top + 1), (1, top + 1), (0, top)))
    exact = (x[:, None] * a + y[:, None] * b + c) % prime
    share = mixing.blocks.Room(exact.size).draws(mixing.blocks.row_parts(x, y), mixing.blocks.word_weights(a, b, c))
    assert (share >= exact / prime).all() and (share < (exact + 1) / prime).all()
    assert (np.abs(share * prime - exact - 0.5) < 0.25).all()
