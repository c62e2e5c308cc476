"""Centroid clustering (k-means) on integer vectors, with bounds that spare most comparisons.

Components become floor(scale x), so distances and means are exact and every run gives the same clusters.

1. Vectors are packed into parts and written once, bucketed by part. A second table with the same buckets holds what is
   known of each vector: its centroid, the second-nearest one, an upper bound of the distance to the first and a lower bound of
   those to all others. Every round joins both without a shuffle and writes the second one anew.
2. Centroids move, so bounds widen by how far. A vector whose upper bound is below its lower one, or below half the
   distance from its centroid to the next, keeps its centroid unseen. For the others the search starts from the closer one of the
   two remembered centroids and goes through its neighbours from the nearest on, as far as the radius: the distance to the start
   plus that to the second-nearest found. It shrinks with each better find.
3. What the ball lets through is compared in integers, ties to the smaller number. Sums of each part and centroid are added up
   by Spark; clusters x dimensions numbers reach the driver.

Vectors that are null, of another dimension, or hold null or non-finite components (also once scaled) are left out. Repeated
rows count each; a null id is kept, and counts as an empty one for the choice of the first centroids. With fewer vectors than
clusters, every vector starts one. Large components are exact, too: beyond 64 bits Python's integers are used, and a distance or
inertia outside the range of a long is given as the largest long. An empty table gives an empty result. Only id and
vector are read; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.llm.common import stored, table
from methmix.llm.registry import query
from methmix.llm.vectors import finite
from methmix.session import scratch_path

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
DIMENSION = 64
SEED = 3
VECTORS_PER_PART = 1024
PARTS_PER_TASK = 8
MOST_BUCKETS = 50_000  # more vectors make larger buckets; Spark allows 100,000
# Bounds are rounded outwards by more than doubles lose.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
LARGEST = (1 << 63) - 1
LIMB_BITS = 40

STATE = np.dtype([("first", np.int32), ("second", np.int32), ("upper", np.float64), ("lower", np.float64)])
TALLY = "array<struct<cluster:int,limb:int,sums:array<bigint>>>"


def fits(largest: int, dim: int) -> bool:
    """Whether squared distances of vectors with components up to `largest` fit into 64 bits."""
    return 4 * dim * largest * largest < 1 << 62


def packed_values(matrix: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them; beyond 32 bits they stay doubles."""
    largest = np.abs(matrix).max(initial=0)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def unpacked_values(kind: str, values: bytes, dim: int) -> tuple[np.ndarray, int]:
    """The matrix as int64, or as Python integers where 64-bit distances don't hold, and its largest component."""
    matrix = np.frombuffer(values, kind).reshape(-1, dim)
    largest = int(np.abs(matrix.astype(np.float64)).max(initial=0))
    if fits(largest, dim):
        return matrix.astype(np.int64), largest
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(-1, dim), largest


class Centroids:
    """The centroids of a round, how far each has moved, and their order around each other."""

    def __init__(self, rows: list[list[int]], before: "Centroids | None" = None):
        self.rows = rows
        self.largest = max((abs(x) for row in rows for x in row), default=0)
        self.narrow = fits(self.largest, len(rows[0]))
        if not self.narrow:
            return
        self.array = np.array(rows, np.int64)
        k = len(rows)
        between = np.sqrt(np.stack([((self.array - c) ** 2).sum(axis=1) for c in self.array]).astype(np.float64)) * DOWN
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.order, axis=1)
        self.half = self.between[:, 0] / 2 if k > 1 else np.full(1, np.inf)
        if before is not None and before.narrow:
            moved = np.sqrt(((self.array - before.array) ** 2).sum(axis=1).astype(np.float64)) * UP
        else:
            moved = np.full(k, np.inf)
        self.moved = moved
        largest = np.argsort(-moved, kind="stable")
        self.others_moved = np.full(k, moved[largest[0]])
        self.others_moved[largest[0]] = moved[largest[1]] if k > 1 else 0.0


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, row by row, in the integers of the inputs."""
    gap = vectors - centroids
    return (gap * gap).sum(axis=1)


def search(vectors: np.ndarray, first: np.ndarray, second: np.ndarray, first_d: np.ndarray, now: Centroids):
    """Nearest and second-nearest centroids (numbers and squared distances), from two remembered ones on."""
    second_d = squares(vectors, now.array[second])
    swap = (second_d < first_d) | ((second_d == first_d) & (second < first))
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    first_d, second_d = np.where(swap, second_d, first_d), np.where(swap, first_d, second_d)
    start, other, reach = first.copy(), second.copy(), np.sqrt(first_d.astype(np.float64)) * UP
    rows = np.arange(len(vectors))
    for step in range(len(now.rows) - 1):
        # The ball shrinks with the second-nearest; neighbours come in order, so who leaves has seen all of it.
        rows = rows[now.between[start[rows], step] <= reach[rows] + np.sqrt(second_d[rows].astype(np.float64)) * UP]
        if not len(rows):
            break
        number = now.order[start[rows], step]
        new = number != other[rows]
        tried, number = rows[new], number[new]
        d = squares(vectors[tried], now.array[number])
        nearest = (d < first_d[tried]) | ((d == first_d[tried]) & (number < first[tried]))
        at = tried[nearest]
        second[at], second_d[at] = first[at], first_d[at]
        first[at], first_d[at] = number[nearest], d[nearest]
        next_ = ~nearest & ((d < second_d[tried]) | ((d == second_d[tried]) & (number < second[tried])))
        at = tried[next_]
        second[at], second_d[at] = number[next_], d[next_]
    return first, second, first_d, second_d


def assign(vectors: np.ndarray, largest: int, state: np.ndarray | None, now: Centroids) -> np.ndarray:
    """The state of every vector after `now`; the first centroid is exact, the bounds hold."""
    k = len(now.rows)
    if state is None:
        state = np.zeros(len(vectors), STATE)
        state["second"], state["upper"] = min(1, k - 1), np.inf
    state = state.copy()
    if not now.narrow or not fits(max(largest, now.largest), vectors.shape[1]):
        # Exact, with nothing known for the next round.
        whole = vectors.astype(object)
        state["first"] = np.argmin(np.stack([squares(whole, np.array(c, object)) for c in now.rows], axis=1), axis=1)
        state["second"], state["upper"], state["lower"] = (state["first"] + 1) % k, np.inf, 0
        return state
    if k == 1:
        return state
    state["upper"] = (state["upper"] + now.moved[state["first"]]) * UP
    with np.errstate(invalid="ignore"):
        state["lower"] = np.maximum(np.nan_to_num(state["lower"] - now.others_moved[state["first"]], nan=0.0), 0) * DOWN
    safe = np.maximum(state["lower"], now.half[state["first"]])
    open_ = np.flatnonzero(state["upper"] >= safe)
    if len(open_):
        d = squares(vectors[open_], now.array[state["first"][open_]])
        state["upper"][open_] = np.sqrt(d.astype(np.float64)) * UP
        left = state["upper"][open_] >= safe[open_]
        open_, d = open_[left], d[left]
    if len(open_):
        first, second, first_d, second_d = search(vectors[open_], state["first"][open_], state["second"][open_], d, now)
        state["first"][open_], state["second"][open_] = first, second
        state["upper"][open_] = np.sqrt(first_d.astype(np.float64)) * UP
        state["lower"][open_] = np.sqrt(second_d.astype(np.float64)) * DOWN
    return state


def limbs(sums: list[int]) -> Iterator[list[int]]:
    """Integers of any size as 64-bit ones: the sum over i of the i-th list, shifted by i * LIMB_BITS."""
    while any(not -LARGEST <= s <= LARGEST for s in sums):
        yield [s & ((1 << LIMB_BITS) - 1) for s in sums]
        sums = [s >> LIMB_BITS for s in sums]
    yield sums


def tally(vectors: np.ndarray, first: np.ndarray) -> list[tuple]:
    """(cluster, limb, sums of the components and the count) of each cluster with vectors."""
    out = []
    for cluster in np.unique(first).tolist():
        own = vectors[first == cluster]
        out += [(cluster, place, part) for place, part in enumerate(limbs([*map(int, own.sum(axis=0)), len(own)]))]
    return out


def _round(now: Centroids, dim: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kind, values, state in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "values", "state"))):
                vectors, largest = unpacked_values(kind, values, dim)
                known = assign(vectors, largest, None if state is None else np.frombuffer(state, STATE), now)
                rows = [{"cluster": c, "limb": place, "sums": sums} for c, place, sums in tally(vectors, known["first"])]
                kinds = pa.list_(pa.struct([("cluster", pa.int32()), ("limb", pa.int32()), ("sums", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([known.tobytes()], pa.binary()), pa.array([rows], kinds)],
                                                 names=["part", "state", "tally"])
    return task


def _last(now: Centroids, dim: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, values, state in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("kind", "values", "state"))):
                vectors, largest = unpacked_values(kind, values, dim)
                first = assign(vectors, largest, None if state is None else np.frombuffer(state, STATE), now)["first"]
                if now.narrow and fits(max(largest, now.largest), dim):
                    distance = squares(vectors, now.array[first])
                else:
                    exact = squares(vectors.astype(object), np.array([now.rows[c] for c in first], object))
                    distance = np.array([min(d, LARGEST) for d in exact], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(first, pa.int32()), pa.array(distance, pa.int64())],
                                                 names=["id", "cluster", "distance"])
    return task


def _pack(scale: int):
    """Rows (part, id, vector) in order of the part as one row per part."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(),
                                                        batch.column("vector").to_numpy(zero_copy_only=False)))
        for part, held in groupby(rows, key=lambda row: row[0]):
            _, ids, vectors = zip(*held)
            kind, values = packed_values(np.floor(scale * np.stack(vectors)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(ids)], pa.list_(pa.int64())),
                                              pa.array([kind]), pa.array([values], pa.binary())], names=["part", "ids", "kind", "values"])
    return task


def bucketed(df: DataFrame, name: str, buckets: int) -> str:
    """Name of a table of `df` in the shared folder, bucketed by part, so that joins on it need no shuffle."""
    title = f"methmix_{name}_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.bucketBy(buckets, "part").sortBy("part").format("parquet").option("path", path).saveAsTable(title)
    return title


def moved_centroids(state: DataFrame, now: Centroids) -> Centroids:
    """The means of the clusters, rounded down; a cluster without vectors stays."""
    entry = state.select(F.explode("tally").alias("t")).select("t.cluster", "t.limb", F.posexplode("t.sums").alias("at", "value"))
    sums = [[0] * (len(row) + 1) for row in now.rows]
    for cluster, limb, at, value in entry.groupBy("cluster", "limb", "at").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        sums[cluster][at] += int(value) << (limb * LIMB_BITS)
    rows = [[s // total[-1] for s in total[:-1]] if total[-1] else row for row, total in zip(now.rows, sums)]
    return Centroids(rows, now)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION,
                    seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of that dimension.

    The first centroids are the vectors with the smallest sha256 of `seed`:id. Every round assigns all vectors and
    moves the centroids; then all are assigned once more. Clusters x dimensions numbers go to every task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter((F.size("vector") == dimension) & finite(F.transform("vector", lambda x: x * float(scale))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(digest, "vector").limit(clusters).collect()
    if not chosen:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = Centroids([[math.floor(scale * x) for x in row["vector"]] for row in chosen])
    parts = rows.count() // VECTORS_PER_PART + 1
    buckets = min(parts // PARTS_PER_TASK + 1, MOST_BUCKETS)
    # The number of a row in its file deals copies of one row apart.
    part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    dealt = rows.withColumn("part", part).repartition(buckets, "part").sortWithinPartitions("part")
    names = [bucketed(dealt.mapInArrow(_pack(scale), "part int, ids array<bigint>, kind string, values binary"), "vectors", buckets)]
    packed = spark.table(names[0])
    joined = packed.withColumn("state", F.lit(None).cast("binary"))
    for _ in range(rounds):
        found = joined.select("part", "kind", "values", "state").mapInArrow(_round(now, dimension), f"part int, state binary, tally {TALLY}")
        names.append(bucketed(found, "state", buckets))
        state = spark.table(names[-1])
        now = moved_centroids(state, now)
        joined = packed.join(state.select("part", "state").hint("merge"), "part")
    last = joined.select("ids", "kind", "values", "state").mapInArrow(_last(now, dimension), "id long, cluster int, distance long")
    assigned = stored(last, "clusters")
    for name in names:
        spark.sql(f"DROP TABLE {name}")  # from the catalog; the files stay with the other tables of the shared folder
    wide, most = "decimal(38,0)", F.lit(LARGEST).cast("decimal(38,0)")
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide))).collect())
    hashes = [(c, min(int(s), LARGEST), min(int(sum(sums.values())), LARGEST),
               hashlib.sha256(",".join(map(str, now.rows[c])).encode()).hexdigest()) for c, s in sums.items()]
    named = spark.createDataFrame(hashes, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _lloyd_sql() -> str:
    """Rounds of assignment and means, one after the other."""
    steps = ["""kept AS (
        SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    )""", """c0 AS (
        SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)
    )"""]
    for turn in range(ROUNDS + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
        SELECT row, vec_id, k.v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
            SELECT k.row, k.vec_id, k.v, c.cluster, list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d
            FROM kept k CROSS JOIN c{turn} c) k GROUP BY row, vec_id, k.v
    )""")
        if turn < ROUNDS:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (
        SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN (
            SELECT cluster, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS v FROM (
                SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{turn}, range(1, 65) r(i) GROUP BY cluster, i)
            GROUP BY cluster) m USING (cluster)
    )""")
    return f"""WITH {', '.join(steps)}
    SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
           sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


@query("op11_centroid_clustering", sql=_lloyd_sql())
def op11_centroid_clustering(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
