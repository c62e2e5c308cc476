"""Mixture designs: which share of which cell type goes into which mixture.

A design has one row per (titrated, proportion_id, cell_type): `titration` is the level of the
titrated cell type, `proportion` the share of this cell type. It grows with levels and cell
types, never with the reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methmix.functions.hashing import derived_seed
from methmix.functions.text import proportion_label
from methmix.session import materialize


def _at_levels(cell_types: DataFrame, titrated: list[str], levels: list[float]) -> DataFrame:
    targets = F.explode(F.array(*[F.lit(t) for t in titrated])).alias("titrated")
    return _steps(cell_types.select("*", targets), levels)


def _steps(titrated: DataFrame, levels: list[float]) -> DataFrame:
    return titrated.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in levels])).alias("proportion_id", "titration"))


def _others(column):
    """Sum over the cell types of a mixture that are not titrated."""
    mixture = Window.partitionBy("titrated", "proportion_id")
    return F.sum(F.when(F.col("cell_type") != F.col("titrated"), column).otherwise(0)).over(mixture)


def uniform_background(cell_types: DataFrame, titrated: list[str], levels: list[float]) -> DataFrame:
    """The titrated type takes its level, the others share the rest evenly.
    `cell_types` has a `cell_type` column."""
    grid = _at_levels(cell_types.select("cell_type"), titrated, levels)
    share = (1 - F.col("titration")) / _others(F.lit(1))
    return grid.withColumn("proportion", F.when(
        F.col("cell_type") == F.col("titrated"), F.col("titration")).otherwise(share))


def custom_background(abundance: DataFrame, titrated: list[str], levels: list[float]) -> DataFrame:
    """The titrated type takes its level, the others share the rest by their abundance.
    `abundance` has `cell_type` and `abundance` columns."""
    grid = _at_levels(abundance.select("cell_type", "abundance"), titrated, levels)
    share = F.col("abundance") / _others(F.col("abundance")) * (1 - F.col("titration"))
    return grid.withColumn("proportion", F.when(
        F.col("cell_type") == F.col("titrated"), F.col("titration")).otherwise(share)).drop("abundance")


def two_level_background(abundance: DataFrame, titrated: list[str], levels: list[float],
                         group_total: float) -> DataFrame:
    """Titration inside one group of cell types.

    `abundance` has `cell_type`, `abundance` and a boolean `in_group`. The group always takes
    `group_total` of the mixture: its titrated member `level` of that, its other members the
    rest by their abundance. Cell types outside the group keep their abundance, so these and
    `group_total` must add up to one; see `complete`.
    """
    grid = _at_levels(abundance.select("cell_type", "abundance", "in_group"), titrated, levels)
    inside = F.when(F.col("in_group"), F.col("abundance")).otherwise(0)
    share = F.col("abundance") / _others(inside) * (1 - F.col("titration")) * group_total
    return grid.withColumn(
        "proportion",
        F.when(~F.col("in_group"), F.col("abundance"))
        .when(F.col("cell_type") == F.col("titrated"), F.col("titration") * group_total)
        .otherwise(share)).drop("abundance", "in_group")


def checked_tree(tree: DataFrame) -> DataFrame:
    """`tree`, once it is one for `tree_background`, but for paths to the top."""
    siblings = Window.partitionBy("titrated", "parent")
    named = tree.withColumns({
        "_same": F.count(F.lit(1)).over(Window.partitionBy("titrated", "node")),
        "_rest": F.sum(F.when(F.col("node") != F.col("titrated"), F.col("share")).otherwise(0)).over(siblings),
        "_found": F.sum((F.col("node") == F.col("titrated")).cast("int")).over(Window.partitionBy("titrated"))})
    faults = {
        "a null or negative share": F.col("share").isNull() | F.isnan("share") | (F.col("share") < 0),
        "a null name": F.col("node").isNull() | F.col("titrated").isNull(),
        "a node twice": F.col("_same") > 1,
        "siblings without a share": (F.col("_rest") <= 0) | F.col("_rest").isNull(),
        "no leaf for the titrated cell type": F.col("_found") != 1,
        "nodes below the titrated cell type": F.col("parent") == F.col("titrated"),
    }
    found = F.coalesce(*[F.when(rule, F.lit(i)) for i, rule in enumerate(faults.values())])
    wrong = named.select("titrated", "node", found.alias("fault")).where("fault IS NOT NULL").orderBy("fault").take(1)
    if wrong:
        raise ValueError(f"the tree of {wrong[0]['titrated']} has {list(faults)[wrong[0]['fault']]} ({wrong[0]['node']})")
    return tree


def tree_background(tree: DataFrame, levels: list[float]) -> DataFrame:
    """Titration of leaves inside trees of cell types, of any depth.

    `tree` has one row per (`titrated`, `node`) with its `parent` (null at the top) and `share`. What a node takes of the mixture is
    divided among its children by their shares, whatever these add up to; the leaves are the cell types. The titrated leaf takes its
    level of its parent's part and its siblings the rest by their shares, each with all that lies below it; other parts
    stay as they are. Every titrated cell type brings its own tree, as the background in its group may depend on it; the share in its own
    row is not used. Wrong trees (see `checked_tree`) and nodes without a path to the top (unknown parents, circles) are
    errors; an empty tree gives an empty design.

    One join for each level of the deepest tree. Tables here grow with nodes and levels, never with the reads.
    """
    nodes = checked_tree(materialize(tree.select("titrated", "node", "parent", F.col("share").cast("double").alias("share")), "design-tree"))
    siblings = Window.partitionBy("titrated", "proportion_id", "parent")
    own = F.col("node") == F.col("titrated")
    rest = F.sum(F.when(~own, F.col("share")).otherwise(0)).over(siblings)
    left = 1 - F.max(F.when(own, F.col("titration")).otherwise(0)).over(siblings)
    parts = _steps(nodes, levels).withColumn(
        "_part", F.when(own, F.col("titration")).otherwise(F.try_divide(F.col("share"), rest) * left)).drop("share")
    parts = materialize(parts, "design-parts")
    reached = [materialize(parts.where("parent IS NULL").withColumnRenamed("_part", "proportion"), "design-top")]
    while not reached[-1].isEmpty():
        above = reached[-1].select("titrated", "proportion_id", F.col("node").alias("parent"), F.col("proportion").alias("_above"))
        below = parts.join(above, ["titrated", "proportion_id", "parent"])
        reached.append(materialize(below.withColumn("proportion", F.col("_above") * F.col("_part")).drop("_above", "_part"), "design-level"))
    every = materialize(reduce(DataFrame.unionByName, reached), "design-nodes")
    lost = parts.join(every, ["titrated", "proportion_id", "node"], "left_anti").take(1)
    if lost:
        raise ValueError(f"the tree of {lost[0]['titrated']} has no path from {lost[0]['node']} to the top")
    inner = nodes.where("parent IS NOT NULL").select("titrated", F.col("parent").alias("node")).distinct()
    return every.join(inner, ["titrated", "node"], "left_anti").select(
        F.col("node").alias("cell_type"), "titrated", "proportion_id", "titration", "proportion")


def complete(design: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """`design`, once the proportions of each of its mixtures are known to add up to one."""
    sums = design.groupBy("titrated", "proportion_id").agg(F.sum("proportion").alias("total"))
    wrong = sums.where(F.col("total").isNull() | (F.abs(F.col("total") - 1) > tolerance)).take(1)
    if wrong:
        raise ValueError(f"proportions add up to {wrong[0]['total']} for {wrong[0]['titrated']}, {wrong[0]['proportion_id']}")
    return design


def combined_truth(design: DataFrame, groups: dict[str, str]) -> DataFrame:
    """True proportion per reference cell type, cell types of one group added up."""
    from methmix.operators.relational import label_column
    return (design.withColumn("ref_celltype", F.coalesce(label_column("cell_type", groups), F.col("cell_type")))
            .groupBy("titrated", "proportion_id", "titration", "ref_celltype")
            .agg(F.sum("proportion").alias("true_proportion")))


def replicate(design: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The design `replicates` times, each (titrated, proportion, replicate) with a seed of
    its own."""
    numbered = design.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    index = F.concat_ws("-", "titrated", F.col("proportion_id").cast("string"), F.col("replicate").cast("string"))
    return numbered.withColumn("seed", derived_seed(F.lit(seed), index))


def mixture_labels(design: DataFrame, names: dict[str, str], order: list[str]) -> DataFrame:
    """One label per mixture, such as `E05B_E015CD4`: titrated type first, then the declared
    order. For people; mixtures are identified by their key columns."""
    from methmix.operators.relational import declared_order, label_column
    place = F.when(F.col("cell_type") == F.col("titrated"), -1).otherwise(declared_order("cell_type", order))
    piece = proportion_label(label_column("cell_type", names), F.col("proportion"))
    parts = F.sort_array(F.collect_list(F.struct(place.alias("place"), piece.alias("piece"))))
    return design.groupBy("titrated", "proportion_id").agg(
        F.array_join(F.transform(parts, lambda p: p["piece"]), "_").alias("label"))
