"""Readers and writers. Operators never do I/O; these functions are the only ones that do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methmix import schema


def read_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """Read tables of one or more sources, matched by column name, with bounds as bigint."""
    frames = [spark.read.parquet(path).select(*schema.READ_COLUMNS) for path in paths]
    reads = frames[0]
    for other in frames[1:]:
        reads = reads.unionByName(other)
    return reads.select(*[F.col(f.name).cast(f.dataType) for f in schema.READS.fields])


def _typed(field: T.StructField) -> Column:
    """A text column in its declared type. A cell that does not fit is an error, never a null."""
    text = F.col(field.name)
    value = text.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"column {field.name} is no {field.dataType.simpleString()}: "), text)).cast(field.dataType)
    return F.when(text.isNotNull() & value.isNull(), wrong).otherwise(value).alias(field.name)


def read_tsv(spark: SparkSession, path: str, table: T.StructType,
             columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text with a header line, plain or gzip. Columns are found by header
    name, so the file may hold more of them or hold them in another order. An empty cell is
    null; one that does not fit its column's type fails the read."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path)
    return header.select(*[_typed(table[n]) for n in columns or table.fieldNames()])


def read_bed(spark: SparkSession, path: str, columns: T.StructType = schema.REGIONS_BED) -> DataFrame:
    """Headerless tab-separated regions; fields beyond the named ones are not parsed, and a
    value that does not fit its type fails the read."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in columns.fields])
    raw = (spark.read.schema(texts).option("sep", "\t").option("header", False)
           .option("enforceSchema", True).csv(path))
    return raw.select(*[_typed(f) for f in columns.fields])


def write_tsv(df: DataFrame, path: str, header: bool = True, compression: str = "gzip") -> None:
    """Tab-separated text, one file per partition."""
    (df.write.mode("overwrite").option("sep", "\t").option("header", header)
     .option("compression", compression).csv(path))


def write_pools(pools: DataFrame, path: str) -> None:
    """Read pools as one table with a folder per cell type."""
    pools.write.mode("overwrite").partitionBy("cell_type").parquet(path)


def load_pools(spark: SparkSession, path: str, cell_types: list[str] | None = None) -> DataFrame:
    """Pools of the given cell types; the folders of the others are not listed for reading."""
    pools = spark.read.parquet(path)
    return pools.where(F.col("cell_type").isin(cell_types)) if cell_types else pools


def pool_counts(pools: DataFrame) -> DataFrame:
    """Rows per cell type, all in one job."""
    return pools.groupBy("cell_type").agg(F.count(F.lit(1)).alias("pool_rows"))


def write_experiment(df: DataFrame, path: str, *keys: str) -> None:
    """A table keyed by mixture; the keys become folders, so a run over all mixtures is one
    scan and a run over one mixture reads one folder."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_experiment(spark: SparkSession, path: str, table: T.StructType) -> DataFrame:
    """All mixtures of an experiment. Their keys come back as columns, never parsed by us."""
    return spark.read.schema(table).parquet(path)


def write_bundle(df: DataFrame, path: str) -> None:
    """Save an evaluation table."""
    df.write.mode("overwrite").parquet(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
