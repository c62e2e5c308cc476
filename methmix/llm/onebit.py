"""Approximate nearest neighbours by cosine, over randomly rotated one-bit codes.

1. Vectors of length 1 are rotated at random into LENGTHEN times their dimension, rounded up to whole words of 64 bits; the sign of
   each coordinate is one bit of the code. Beside it stands the inner product of the vector and the corner of the
   cube that its code names. Blocks of vectors and codes are written once.
2. A rotated query is rounded to LEVELS steps. Counted bits of its bit planes and the packed codes give its inner product with the
   corner; divided by the number beside the code, that estimates the cosine without bias, with an error that shrinks with the
   code's length. SPREAD standard errors, and what the rounding can add, bound it.
3. A candidate whose upper bound lies under the best k-th value known is passed over; the others are ranked by the
   exact cosine. The first value known for a query comes from its meeting with one block; then it meets all of them, and
   within a block the best estimates, ranked first, raise it. Only candidates at or above it leave a task.

A neighbour is lost if its estimate errs by more than SPREAD standard errors, about 6 in 100,000 for 4; tests measure recall.
Scores are cosines of the original vectors in double precision, summed in order of the components. Vectors that are null, empty, zero or hold
null or non-finite components, and rows without id, take no part. Only vectors of the query's dimension and of another id are
candidates. Repeated rows are candidates each; a query id is searched once, with the first of its rows by vector. An empty
table gives an empty result. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methmix.llm.common import stored, table
from methmix.llm.registry import query
from methmix.llm.vectors import PACKED, PACKED_ARROW, dealt, everywhere, finite, gathered, in_turn, meetings, pack, small_batches, unpack

TOP = 5
LENGTHEN = 4
PLANES = 7          # bits of a rounded query
SPREAD = 4.0
FIRST_RANKED = 4    # times k candidates of a block, ranked exactly to begin with
SEED = 12
VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 256
QUERY_BLOCKS_PER_TASK = 32
WORD_BITS = 64
# Doubles lose less than this in a cosine.
ROUNDING = 1e-9


def plain(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two where their squares could leave the range of doubles, which changes no cosine."""
    largest = np.abs(vectors).max(axis=1)
    far = (largest > 1e120) | (largest < 1e-120)
    if far.any():
        vectors = vectors.copy()
        vectors[far] = np.ldexp(vectors[far], -np.frexp(largest[far])[1][:, None])
    return vectors


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added one after the other."""
    # Running sums add in that order; adding 0 turns -0 into 0.
    return np.add.accumulate(a * b, axis=1)[:, -1] + 0.0


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """dim x bits matrix with orthonormal rows; the same in every task."""
    bits = -(-dim * LENGTHEN // WORD_BITS) * WORD_BITS
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(bits, dim)))
    return (q * np.sign(np.diag(r))).T.copy()


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint64 words) and the inner product of each vector with its corner."""
    turned = units @ rotation(units.shape[1])
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    return codes, np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


class Question:
    """A rotated query rounded to 2^PLANES steps, as bit planes of the width of a code."""

    def __init__(self, unit_query: np.ndarray, turned: np.ndarray | None = None):
        turned = unit_query @ rotation(len(unit_query)) if turned is None else turned
        self.bits = len(turned)
        self.low = turned.min()
        self.step = max((turned.max() - self.low) / ((1 << PLANES) - 1), 1e-300)
        steps = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.total = int(steps.sum())
        bits = (steps >> np.arange(PLANES, dtype=np.uint8)[:, None]) & np.uint8(1)
        self.planes = list(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        rounded = self.low + self.step * steps
        # The corner's coordinates are +-1 / sqrt(bits), so rounding shifts the product by no more than this.
        self.slack = np.abs(turned - rounded).sum() / math.sqrt(self.bits)

    @classmethod
    def all(cls, units: np.ndarray) -> list["Question"]:
        return [cls(u, t) for u, t in zip(units, units @ rotation(units.shape[1]))]

    def products(self, codes: np.ndarray, ones: np.ndarray | None = None) -> np.ndarray:
        """Inner products of the rounded query with the corners of the codes; `ones` are the codes' set bits."""
        ones = set_bits(codes) if ones is None else ones
        inside = np.zeros(len(codes), np.int64)
        for p, plane in enumerate(self.planes):
            inside += set_bits(codes, plane).astype(np.int64) << p
        # Coordinates with a set bit count +, the others -: twice the sum over the set ones less the sum over all.
        return (2 * (self.low * ones + self.step * inside) - (self.low * self.bits + self.step * self.total)) / math.sqrt(self.bits)

    def bounds(self, codes: np.ndarray, corners: np.ndarray, ones: np.ndarray | None = None,
               spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines, and the errors they are taken to stay within."""
        error = (spread_of(corners, self.bits) if spread is None else spread) + self.slack
        return self.products(codes, ones) / corners, error / corners + ROUNDING


def set_bits(codes: np.ndarray, plane: np.ndarray | None = None) -> np.ndarray:
    """Set bits of each code, or those that `plane` has, too; word by word, as codes are few words of many rows."""
    total = np.zeros(len(codes), np.uint32)
    for word in range(codes.shape[1]):
        total += np.bitwise_count(codes[:, word] if plane is None else codes[:, word] & plane[word])
    return total


def spread_of(corners: np.ndarray, bits: int) -> np.ndarray:
    return SPREAD * np.sqrt(np.maximum(1 - corners * corners, 0) / (bits - 1))


class Block:
    """A block of candidates: exact vectors, codes and corners."""

    def __init__(self, ids: bytes, vectors: bytes, codes: bytes, corners: bytes, dim: int):
        self.ids, self.vectors = unpack(ids, vectors, dim)
        # Words of all codes lie side by side.
        self.codes = np.asfortranarray(np.frombuffer(codes, np.uint64).reshape(len(self.ids), -1))
        self.corners = np.frombuffer(corners, np.float64)
        self.norms = np.sqrt(in_order(self.vectors, self.vectors))
        self.ones = set_bits(self.codes)
        self.spread = spread_of(self.corners, self.codes.shape[1] * WORD_BITS)

    def cosines(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        return in_order(self.vectors[places], q[None]) / (np.sqrt(in_order(q[None], q[None]))[0] * self.norms[places])

    def near(self, query_id: int, q: np.ndarray, k: int, floor: float,
             question: Question | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and cosines of the `k` best candidates found, those under `floor` left out, and how many were ranked exactly."""
        question = Question(unit(q[None])[0]) if question is None else question
        estimate, error = question.bounds(self.codes, self.corners, self.ones, self.spread)
        above = estimate + error
        kept = np.flatnonzero(above >= floor)
        kept = kept[self.ids[kept] != query_id]
        few = FIRST_RANKED * k
        if len(kept) > few:
            # The best estimates, ranked exactly, say what the others must reach.
            ahead = kept[np.argpartition(-estimate[kept], few - 1)[:few]]
            kept = kept[above[kept] >= np.partition(self.cosines(ahead, q), few - k)[few - k]]
        if not len(kept):
            return self.ids[:0], self.corners[:0], 0
        exact = self.cosines(kept, q)
        order = np.lexsort((self.ids[kept], -exact))[:k]
        return self.ids[kept[order]], exact[order], len(kept)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, block, ids, vectors in gathered(batches, plain):
        codes, corners = encode(unit(vectors))
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([block], pa.int32()),
             *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, corners))], names=[*PACKED_ARROW.names, "codes", "corners"])


def _block(rows: list[dict]) -> Block:
    """The block of a row; a block has one."""
    row, = rows
    return Block(row["ids"], row["vectors"], row["codes"], row["corners"], row["dim"])


FOUND = "query_id long, dim int, q_block int, vec_id long, score double, n_ranked long"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("dim", pa.int32()), ("q_block", pa.int32()), ("vec_id", pa.int64()),
                         ("score", pa.float64()), ("n_ranked", pa.int64())])


def _search(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in meetings(batches, _block):
            floors = dict(zip(row["asked"] or [], row["floors"] or []))
            q_ids, vectors = unpack(row["q_ids"], row["q_vectors"], row["dim"])
            found = [block.near(query_id, q, k, floors.get(query_id, -np.inf), question)
                     for query_id, q, question in zip(q_ids, vectors, Question.all(unit(vectors)))]
            counts = [len(ids) for ids, _, _ in found]
            n = sum(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, counts), pa.int64()), pa.array(np.full(n, row["dim"]), pa.int32()),
                 pa.array(np.full(n, row["q_block"]), pa.int32()), pa.array(np.concatenate([ids for ids, _, _ in found]), pa.int64()),
                 pa.array(np.concatenate([scores for _, scores, _ in found])),
                 pa.array(np.repeat([ranked for _, _, ranked in found], counts), pa.int64())], schema=FOUND_ARROW)
    return task


def nearest(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` largest cosines found for each query.

    Both inputs have id (bigint) and vector (array of numbers).
    """
    usable = F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    queries = queries.filter(usable).groupBy("id").agg(F.min("vector").alias("vector"))
    candidates = candidates.filter(usable)
    blocks = candidates.count() // VECTORS_PER_BLOCK + 1
    asked = queries.count() // QUERIES_PER_BLOCK + 1
    with small_batches(candidates.sparkSession):
        coded = stored(dealt(candidates, blocks).mapInArrow(_encode, PACKED + ", codes binary, corners binary"), "codes").withColumn("turn", F.lit(0))
        packed = stored(pack(queries, asked, plain), "questions")
        # Each block of queries first meets one block of candidates, another one for each.
        first = (everywhere(packed, 1, 1).withColumn("block", F.pmod(F.xxhash64("q_block"), F.lit(blocks)).cast("int"))
                 .withColumns({"asked": F.array().cast("array<bigint>"), "floors": F.array().cast("array<double>")}))
        known = (in_turn(coded, first, blocks, 1).mapInArrow(_search(k), FOUND)
                 .groupBy("query_id", "dim", "q_block").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")))
        # Fewer than k scores bound nothing. A block of queries has no more floors than queries.
        floors = known.filter(F.col("n") >= k).groupBy("dim", F.col("q_block").alias("block")).agg(
            F.collect_list("query_id").alias("asked"), F.collect_list("floor").alias("floors"))
        bounded = stored(packed.join(floors, ["dim", "block"], "left"), "bounded-questions")
        # A block of candidates meets the query blocks of a salt in one task.
        salts = asked // QUERY_BLOCKS_PER_TASK + 1
        found = stored(in_turn(coded, everywhere(bounded, blocks, salts), blocks, salts).mapInArrow(_search(k), FOUND), "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op12_nearest_neighbours", sql="""
    WITH v AS (
        SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.norm * c.norm) AS score
        FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op12_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors.filter("id % 50 = 0"), vectors)
