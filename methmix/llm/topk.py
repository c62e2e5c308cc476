"""Exact top-k search by columnar branch and bound.

Query blocks meet candidate blocks. Within a block, candidates lie dimension by dimension. A query adds up its products for
a few dimensions at a time; what the other dimensions can still add is bounded by the product of the
norms left. Candidates that cannot reach the k-th best lower bound are dropped and the rest is compacted. The best k of
every block meet again by query.

Components are floor(64 x), so scores are integers; doubles hold them exactly below 2^53, beyond that Python integers
are used, and a score outside the range of a long is given as its nearest long. Vectors that are null, empty or
hold null or non-finite components, and rows without id, take no part. Only vectors of the query's dimension and
of another id are candidates. Repeated rows are candidates each; a query id is searched once, with the first
of its rows by vector. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methmix.llm.common import stored, table
from methmix.llm.registry import query
from methmix.llm.vectors import finite, meet, pack, unpack

TOP = 20
CANDIDATES_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 256
QUERY_BLOCKS_PER_TASK = 8
STEP = 16
EXACT = float(2**53)
LONG = np.iinfo(np.int64)


def quantized(vectors: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * vectors)


class Candidates:
    """A block in vertical layout, with the norms of the dimensions from each step on."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(vectors.T)
        self.steps = list(range(0, len(self.columns), STEP))
        self.left = [np.sqrt((self.columns[s + STEP:] ** 2).sum(axis=0)) for s in self.steps]
        self.largest = np.abs(vectors).max(initial=0)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the `k` best candidates, ties to smaller ids."""
        alive = np.flatnonzero(self.ids != query_id)
        if len(q) * self.largest * np.abs(q).max(initial=0) >= EXACT:
            scores = np.array([sum(int(a) * int(b) for a, b in zip(q, self.columns[:, c])) for c in alive], dtype=object)
            order = sorted(range(len(alive)), key=lambda i: (-scores[i], self.ids[alive[i]]))[:k]
            return self.ids[alive[order]], np.array([min(max(scores[i], LONG.min), LONG.max) for i in order], np.int64)
        partial = np.zeros(len(alive))
        whole = len(alive) == len(self.ids)
        for s, left in zip(self.steps, self.left):
            columns = self.columns[s:s + STEP]
            # Until the first compaction the block is read in place.
            partial += q[s:s + STEP] @ (columns if whole else columns[:, alive])
            if len(alive) <= k:
                continue
            # A little more than the product, for rounding.
            slack = np.sqrt((q[s + STEP:] ** 2).sum()) * (left if whole else left[alive]) * (1 + 1e-9) + 1e-6 * (s + STEP < len(q))
            floor = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
            keep = np.flatnonzero(partial + slack >= floor)
            if len(keep) < 0.8 * len(alive) or s == self.steps[-1]:
                alive, partial, whole = alive[keep], partial[keep], False
        order = np.lexsort((self.ids[alive], -partial))[:k]
        return self.ids[alive[order]], partial[order].astype(np.int64)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for dim, number, ids, vectors, q_ids, q_vectors in zip(*(
                    batch.column(c).to_pylist() for c in ("dim", "block", "ids", "vectors", "q_ids", "q_vectors"))):
                if last != (dim, number):
                    last, block = (dim, number), Candidates(*unpack(ids, vectors, dim))
                found = [(i, *block.best(i, q, k)) for i, q in zip(*unpack(q_ids, q_vectors, dim))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([i for i, _, _ in found], np.int64), [len(c) for _, c, _ in found])),
                     pa.array(np.concatenate([c for _, c, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))],
                    schema=schema)
    return task


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` best inner products of each query.

    Both inputs have id (bigint) and vector (array of numbers).
    """
    usable = F.col("id").isNotNull() & finite(F.col("vector"))
    queries = queries.filter(usable).groupBy("id").agg(F.min("vector").alias("vector"))
    candidates = candidates.filter(usable)
    blocks = candidates.count() // CANDIDATES_PER_BLOCK + 1
    asked = queries.count() // QUERIES_PER_BLOCK + 1
    packed = stored(pack(candidates, blocks, quantized), "candidates")
    pairs = meet(pack(queries, asked, quantized), packed, blocks, asked // QUERY_BLOCKS_PER_TASK + 1)
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op10_exact_topk", sql="""
    WITH v AS (
        SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(vectors.filter("id % 20 = 0"), vectors)
