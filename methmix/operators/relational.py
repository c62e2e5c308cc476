"""Small relational steps used between the larger operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window



# ---- filters and relabelling ------------------------------------------------
def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of a short literal list; reaches the parquet scan."""
    return df.where(F.col(column).isin(list(values)))


def min_coverage(scores: DataFrame, min_molecules: int) -> DataFrame:
    return scores.where(F.col("number_molecules") >= min_molecules)


def contains_any(column: str, words: list[str]) -> Column:
    """1 if the text contains any of the words, else 0."""
    hit = reduce(lambda a, b: a | b, [F.col(column).contains(w) for w in words])
    return F.when(hit, 1).otherwise(0)


def label_column(column: str, labels: dict[str, str]) -> Column:
    """The label of a value, null without one. For short fixed tables; see `label_join`."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def relabel(df: DataFrame, column: str, labels: dict[str, str], output: str) -> DataFrame:
    """Rows with a label, and that label as `output`."""
    return df.withColumn(output, label_column(column, labels)).where(F.col(output).isNotNull())


def label_join(df: DataFrame, column: str, labels: DataFrame, key: str) -> DataFrame:
    """The same with a label table of any size (unique `key`)."""
    table = labels.withColumnRenamed(key, column)
    return df.join(table, column)


def relabel_where(column: str, values: dict[str, str], otherwise: str) -> Column:
    """The label of `column` where it has one, `otherwise` elsewhere."""
    return F.coalesce(label_column(column, values), F.col(otherwise))


def override(column: str, replacements: dict[str, str]) -> Column:
    """`column` with some of its values replaced."""
    return relabel_where(column, replacements, column)


def declared_order(column: str, order: list[str]) -> Column:
    """0-based place of a value in a declared list, null outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(place > 0, place - 1)


def number_within(df: DataFrame, keys: list[str], order: list[str], output: str) -> DataFrame:
    """Numbers the rows of each key from 0."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(output, F.row_number().over(window) - 1)


# ---- joins and key sets -----------------------------------------------------
def rows_with_key(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def keys_missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct keys of `df` that `other` does not have."""
    return df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def keys_in_all(df: DataFrame, key: str, source: str, n_sources: int) -> DataFrame:
    """Keys present in every one of `n_sources` sources."""
    return (df.select(key, source).distinct().groupBy(key)
            .agg(F.count(F.lit(1)).alias("_sources"))
            .where(F.col("_sources") == n_sources).select(key))


def combine_methods(estimates: DataFrame, keys: list[str], methods: list[str],
                    how: str = "full") -> DataFrame:
    """One row per key with a `coeff_<method>` column per method.

    how="full" keeps keys some methods lack (null coefficient), how="inner" only complete ones.
    One aggregation, not a join per method.
    """
    wide = (estimates.where(F.col("method").isin(methods)).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("method") == m, F.col("coeff"))).alias(f"coeff_{m}")
                   for m in methods]))
    return wide if how == "full" else wide.dropna(subset=[f"coeff_{m}" for m in methods])


def describe_samples(samples: DataFrame, donors: DataFrame, include_unlisted: bool = False) -> DataFrame:
    """Sample group, age and donor sex per sample. Donor rows are one per file, so they are
    reduced to one per sample first. `include_unlisted` adds donors without sample metadata,
    with the donor's own cell type as group."""
    one = donors.groupBy(F.col("SAMPLE_ID").alias("_donor")).agg(F.min("DONOR_SEX").alias("sex"), F.min("CELL_TYPE").alias("_type"))
    listed = samples.select("sample_id", "sample_group", "age").distinct()
    matched = listed.join(one.select("_donor", "sex"), F.col("sample_id") == F.col("_donor")) \
        .select("sample_id", "sample_group", "age", "sex")
    if not include_unlisted:
        return matched
    extra = one.join(listed, F.col("_donor") == F.col("sample_id"), "left_anti").select(
        F.col("_donor").alias("sample_id"), F.col("_type").alias("sample_group"),
        F.lit(None).cast("string").alias("age"), "sex")
    return matched.unionByName(extra)


# ---- counting and reshaping -------------------------------------------------
def group_sizes(df: DataFrame, *keys: str, missing: str = "none") -> DataFrame:
    """Rows per key, null keys counted under `missing`."""
    return (df.select(*keys).fillna(missing).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows")))


def distinct_per_group(df: DataFrame, group: str, value: str, output: str) -> DataFrame:
    """Distinct values per group, counted in two steps so that a crowded group is spread over
    its values."""
    return (df.select(group, value).where(F.col(value).isNotNull()).distinct()
            .groupBy(group).agg(F.count(F.lit(1)).alias(output)))


def count_summary(df: DataFrame, column: str) -> DataFrame:
    """Distribution of a count column: n, total, mean, sample sd, minimum, quartiles, maximum."""
    quartile = lambda q: F.percentile(column, q)
    return df.agg(
        F.count(column).alias("n"), F.sum(column).alias("total"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("sd"), F.min(column).alias("min"), quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"), quartile(0.75).alias("q3"), F.max(column).alias("max"))


def median_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median of a value per group."""
    return df.groupBy(group).agg(F.percentile(value, 0.5).alias("median"))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count of every column, one row per column. NaN counts as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def missing(name: str) -> Column:
        null = F.col(name).isNull()
        floating = isinstance(kinds[name], (T.DoubleType, T.FloatType))
        return null | F.isnan(name) if floating else null

    counted = df.agg(*[F.count_if(missing(c)).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column", "nulls")


def nulls_per_row(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def wide(df: DataFrame, rows: str, columns: str, values: str, names: list[str]) -> DataFrame:
    """Matrix form: one row per `rows`, one column per name, mean of the values in a cell.
    Written as one aggregation over a declared name list, so there is one shuffle and no pass
    to find the names."""
    return df.groupBy(rows).agg(*[
        F.avg(F.when(F.col(columns) == name, F.col(values))).alias(name) for name in names])


def long(df: DataFrame, rows: str, names: list[str], column: str, value: str) -> DataFrame:
    """Long form of a matrix."""
    return df.unpivot([rows], names, column, value)


def value_counts(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows per value, with the value's place in a declared order; null for values, and for
    null itself, that are not in it."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("place", declared_order(column, order)))


def histogram(df: DataFrame, value: str, bins: int = 20, group: str | None = None) -> DataFrame:
    """Equal-width histogram between minimum and maximum, and the median, per group.
    The top bin is closed; every bin is reported, empty ones too."""
    keys = [group] if group else []
    by = df.groupBy(*keys)
    limits = by.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
                    F.percentile(value, 0.5).alias("median"))
    # One row per group, or one in all.
    ranged = df.join(limits, group) if group else df.crossJoin(F.broadcast(limits))
    position = F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    placed = ranged.select(
        *keys, F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"))
    counts = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("rows"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"), "median")


def union_positional(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by position."""
    return reduce(DataFrame.union, frames)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first `n` rows of an order; Spark keeps `n` per task and merges."""
    return df.orderBy(*order).limit(n)
