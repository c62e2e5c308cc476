"""Vectors packed into blocks, shared by the searches over embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "dim int, block int, ids binary, vectors binary"
PACKED_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
ASKING = 2**31 - 1  # the turn of queries, after all rows of their block
MOST_PARTS = 2000   # tasks of a step; more blocks share tasks
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = str(4 << 20)


def finite(vector: Column) -> Column:
    """Whether a vector has components, and all are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def dealt(vectors: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, vector) dealt to `blocks` blocks by hash of the id; a task gets whole blocks, one after the other, by id."""
    rows = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                          "id", F.col("vector").cast("array<double>").alias("vector"))
    parts = min(blocks, MOST_PARTS)
    return rows.repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("dim", "block", "id")


def gathered(batches: Iterator[pa.RecordBatch], transform) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Dimension, number, ids and transformed vectors of each block of `dealt` rows; one block is held at a time."""
    key, ids, rows = None, [], []
    for batch in batches:
        dims, numbers, own = (batch.column(c).to_numpy() for c in ("dim", "block", "id"))
        values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        at = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
        new = np.flatnonzero((dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1])) + 1
        for low, high in zip([0, *new], [*new, len(own)] if len(own) else []):
            if key != (dims[low], numbers[low]):
                if ids:
                    yield int(key[0]), int(key[1]), np.concatenate(ids), np.concatenate(rows)
                key, ids, rows = (dims[low], numbers[low]), [], []
            ids.append(own[low:high])
            rows.append(transform(values[at[low]:at[high]].reshape(-1, dims[low])))
    if ids:
        yield int(key[0]), int(key[1]), np.concatenate(ids), np.concatenate(rows)


def pack(vectors: DataFrame, blocks: int, transform) -> DataFrame:
    """Rows (id, vector) as one row per dimension and block of double vectors; `blocks` blocks by hash of the id.

    `transform` maps a matrix of vectors, one in a row, row by row. Blocks of a table of n rows hold about n / `blocks`.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, block, ids, matrix in gathered(batches, transform):
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], schema=PACKED_ARROW)

    return dealt(vectors, blocks).mapInArrow(task, PACKED)


def meet(queries: DataFrame, blocks: DataFrame, count: int, salts: int) -> DataFrame:
    """Every query block with every block of its dimension: q_ids, q_vectors beside the columns of `blocks`.

    A block meets the query blocks of a salt in one task; `salts` copies of it share the work.
    """
    asked = (queries.withColumn("salt", F.pmod(F.col("block"), F.lit(salts)))
             .select("dim", "salt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"),
                     F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return asked.join(copies, ["dim", "block", "salt"])


def everywhere(queries: DataFrame, count: int, salts: int) -> DataFrame:
    """Every query block beside the numbers of the `count` blocks, and the salt under which it meets them."""
    return (queries.withColumns({"salt": F.pmod("block", F.lit(salts)), "q_block": F.col("block")})
            .withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))))


def in_turn(blocks: DataFrame, queries: DataFrame, count: int, salts: int) -> DataFrame:
    """Rows of both in one stream: for each dim, block and salt the rows of the block by `turn`, then the queries it meets.

    Unlike a join this sends a block once for all its queries. `blocks` has dim, block (below `count`) and turn; `queries` has
    dim, block and salt (below `salts`). `salts` copies of a block share the work.
    """
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = copies.unionByName(queries.withColumn("turn", F.lit(ASKING)), allowMissingColumns=True)
    parts = min(count * salts, MOST_PARTS)
    place = F.pmod(F.col("block").cast("bigint") * salts + F.col("salt"), F.lit(parts)).cast("int")
    return both.repartitionById(parts, place).sortWithinPartitions("dim", "block", "salt", "turn")


def meetings(batches: Iterator[pa.RecordBatch], load) -> Iterator[tuple]:
    """(block, query row) for each meeting of rows `in_turn`; `load` makes a block of its rows. One block is held at a time."""
    key, rows, block = None, [], None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            own = row["dim"], row["block"], row["salt"]
            if row["turn"] != ASKING:
                if own != key:
                    key, rows, block = own, [], None
                rows.append(row)
            elif own == key:
                if block is None:
                    block, rows = load(rows), []
                yield block, row


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold whole blocks reach Python tasks few at a time, in what runs inside."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, SMALL_BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
