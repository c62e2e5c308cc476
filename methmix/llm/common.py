"""Helpers shared by the operators: input tables, stored intermediate tables, numbering and running sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methmix.session import materialize

# A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rows that one task numbers at once; more rows make more buckets.
ROWS_PER_BUCKET = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that later steps start from a table."""
    return materialize(df, f"llm-{name}")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without the columns of these names, in any case: an operator's own columns replace them."""
    wanted = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted])


def buckets_for(rows: int) -> int:
    return rows // ROWS_PER_BUCKET + 1


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column | None, out: str,
                buckets: int) -> DataFrame:
    """`df` with the sum of `value` (1 if None) over the rows of the same `keys` that come earlier.

    Rows are dealt to `buckets` by a hash of `order`; a bucket's rows are summed in one task and the
    buckets' totals, `buckets` rows for each key, give each bucket its start. With value None the
    column numbers the rows of a key from 0 without gaps. Rows equal in `order` come in any order.
    """
    value = F.lit(1).cast("bigint") if value is None else value
    dealt = df.withColumns({"__llm_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)), "__llm_value": value})
    totals = dealt.groupBy(*keys, "__llm_bucket").agg(F.sum("__llm_value").alias("__llm_total"))
    starts = totals.select(*keys, "__llm_bucket", (F.sum("__llm_total").over(Window.partitionBy(*keys).orderBy("__llm_bucket"))
                                              - F.col("__llm_total")).alias("__llm_start"))
    inside = Window.partitionBy(*keys, "__llm_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("__llm_inside", F.sum("__llm_value").over(inside) - F.col("__llm_value"))
    return (summed.join(starts, [*keys, "__llm_bucket"])
            .withColumn(out, F.col("__llm_start") + F.col("__llm_inside"))
            .drop("__llm_bucket", "__llm_value", "__llm_start", "__llm_inside"))
