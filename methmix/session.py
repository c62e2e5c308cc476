"""Session set-up and the few helpers that depend on the running cluster."""

from __future__ import annotations

import os
import re
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A build side must stay under both limits to be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, folder: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own. `folder` is its
    shared folder, a new temporary one by default."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("methmix")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="methmix-"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by themselves: installed, on
    PYTHONPATH, or in the folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if root in map(os.path.realpath, found) or spark.conf.get("spark.methmix.shipped", None):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="methmix-"), "methmix.zip")  # the driver serves it from there
    with zipfile.ZipFile(archive, "w") as package:
        for folder, _, names in os.walk(os.path.join(root, "methmix")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.methmix.shipped", "true")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in `spark.checkpoint.dir`.

    Only a session whose executor is the driver itself may do without: it gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="methmix-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the plan is cut, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` is proven small. Looks at no more than `max_rows + 1` rows."""
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 8 + 24
        else:
            width = width + 8
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is proven small, unchanged otherwise; Spark then
    joins it by shuffle, with adaptive skew splitting."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def deal_single_file(df: DataFrame) -> DataFrame:
    """A table of one file dealt to all cores if few of its read tasks get its rows: a row group goes to one task as a whole.
    What each task gets is counted without reading a column. A file of many row groups passes through untouched, as dealing
    shuffles and sorts every row, and so do tables of several files, whatever the cluster."""
    if len(df.inputFiles()) != 1:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    every, most = tasks.agg(F.sum("n"), F.max("n")).first()
    return df if every is None or most * cores <= 2 * every else df.repartition(cores)
