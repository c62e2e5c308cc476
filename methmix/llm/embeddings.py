"""Embedding near-dedup with a small-world graph per shard.

1. Equal vectors form a class; classes are dealt to shards by hash, and each shard builds a graph.
2. Every class searches every shard with a beam; what it finds is verified by cosine in double precision, and the links
   are joined to components.
3. An audit compares a sample of the classes, a share of every shard, with all vectors. It grows until AUDITED_LINKED
   classes with links have been checked, or every class. While less than RECALL of these have all their links in their own
   component, the beam doubles. What the audit finds is joined to the links, so that an audit of every class is exact.
4. All links of a vector lie within its component, so its number is counted there, block by block.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0, a component of their
own. Vectors of different dimensions are not compared. A null id counts as larger than all others. Repeated
rows link with each other. An empty table gives an empty result. Only id and vector are read; extra columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.llm.common import stored, table
from methmix.llm.components import components
from methmix.llm.hnsw import Graph
from methmix.llm.registry import query
from methmix.llm.vectors import ASKING, dealt, everywhere, finite, gathered, in_turn, meetings, pack, small_batches, unpack

COSINE = 0.95
LEAST_SHARDS = 6
VECTORS_PER_SHARD = 100_000
NUMBERS_PER_SHARD = 64 * VECTORS_PER_SHARD
PIECE_BYTES = 4 << 20
LABELS = ASKING - 1
VECTORS_PER_QUERY_BLOCK = 1024
QUERY_BLOCKS_PER_TASK = 64
BEAM = 16
AUDITED = 512            # classes of the first sample at least
AUDITED_SHARE = 0.001    # of all classes
AUDITED_GROWTH = 8
AUDITED_LINKED = 4000    # classes with links to check; RECALL means little on fewer
AUDITED_ROWS = 256       # compared with a shard at once
RECALL = 0.999
COUNT_BLOCK = 2048
LAST_ID = np.iinfo(np.int64).max


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; the first division keeps squares of large components finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


PIECES = "dim int, block int, turn int, ids binary, vectors binary, layers array<binary>"
PIECES_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("turn", pa.int32()), ("ids", pa.binary()),
                          ("vectors", pa.binary()), ("layers", pa.list_(pa.binary()))])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graph of every shard in pieces of PIECE_BYTES; a layer's links are cut like the vectors."""
    for dim, block, ids, exact in gathered(batches, unit):
        layers = Graph.build(exact.astype(np.float32)).layers
        some = max(1, PIECE_BYTES // (8 * dim))
        for turn, at in enumerate(range(0, len(ids), some)):
            cut = Graph(None, [links[at:at + some] for links in layers]).to_bytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([turn], pa.int32()),
                 pa.array([ids[at:at + some].tobytes()], pa.binary()), pa.array([exact[at:at + some].tobytes()], pa.binary()),
                 pa.array([cut], pa.list_(pa.binary()))], schema=PIECES_ARROW)


LINKS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=LINKS_ARROW)


def _shard(pieces: list[dict]) -> tuple[np.ndarray, np.ndarray, Graph]:
    """Ids, vectors and graph of a shard."""
    ids, exact = map(np.concatenate, zip(*(unpack(p["ids"], p["vectors"], p["dim"]) for p in pieces)))
    return ids, exact, Graph.from_bytes(exact.astype(np.float32), [b"".join(links) for links in zip(*(p["layers"] for p in pieces))])


def _search(beam: int, cosine: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, exact, graph), row in meetings(batches, _shard):
            q_ids, q = unpack(row["q_ids"], row["q_vectors"], row["dim"])
            nodes, sims = graph.search(q.astype(np.float32), beam)
            a, b = np.nonzero((nodes >= 0) & (sims >= cosine - 1e-3))
            found = nodes[a, b]
            true = np.einsum("ij,ij->i", q[a], exact[found]) >= cosine
            u, v = q_ids[a[true]], ids[found[true]]
            yield _links(u[u != v], v[u != v])
    return task


def _labelled(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors (in double and single precision) and components of each piece of a shard, which come after the pieces."""
    known = [r for r in rows if r["turn"] == LABELS]
    nodes, labels = (np.array([x for r in known for x in r[c]], np.int64) for c in ("nodes", "labels"))
    order = np.argsort(nodes)
    nodes, labels = nodes[order], labels[order]
    pieces = []
    for row in rows:
        if row["turn"] != LABELS:
            ids, exact = unpack(row["ids"], row["vectors"], row["dim"])
            own = ids.copy()  # one without a component is its own
            if len(nodes):
                at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
                own = np.where(nodes[at] == ids, labels[at], ids)
            pieces.append((ids, exact, exact.astype(np.float32), own))
    return pieces


def _audit(cosine: float):
    """Every audited class with all of a shard: a link to each component in which it has links."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, row in meetings(batches, _labelled):
            q_ids, q = unpack(row["q_ids"], row["q_vectors"], row["dim"])
            single = q.astype(np.float32)
            met: dict[tuple[int, int], tuple[int, int]] = {}
            for ids, exact, short, labels in pieces:
                for at in range(0, len(q), AUDITED_ROWS):
                    near = single[at:at + AUDITED_ROWS] @ short.T >= cosine - 1e-3
                    for place in np.flatnonzero(near.any(axis=1)):
                        found = np.flatnonzero(near[place])
                        found = found[(exact[found] @ q[at + place] >= cosine) & (ids[found] != q_ids[at + place])]
                        _, first = np.unique(labels[found], return_index=True)
                        for f in found[first]:
                            met.setdefault((at + place, int(labels[f])), (q_ids[at + place], ids[f]))
            yield _links(*np.array(list(met.values()), np.int64).reshape(-1, 2).T)
    return task


def _count(cosine: float):
    """Per left member of a block pair, the copies of the right members that it is linked with."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, counts = [], []
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for _, group in groupby(rows, key=itemgetter(0, 1, 2)):
            sides: tuple[list, list] = ([], [])
            for _, _, _, side, node, copies, vector in group:
                sides[side].append((node, copies, vector))
            lefts, rights = sides
            if lefts and rights:
                a, b = unit(np.array([v for _, _, v in lefts])), unit(np.array([v for _, _, v in rights]))
                a_nodes, b_nodes = np.array([n for n, _, _ in lefts]), np.array([n for n, _, _ in rights])
                linked = (a @ b.T >= cosine) & (a_nodes[:, None] != b_nodes)
                nodes.append(a_nodes)
                counts.append(linked @ np.array([c for _, c, _ in rights], np.int64))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()),
                                              pa.array(np.concatenate(counts), pa.int64())], schema=schema)
    return task


def link_components(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, component) of every class (node, vector) that is linked with another one."""
    points = classes.select(F.col("node").alias("id"), "vector")
    count, numbers = points.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, count // VECTORS_PER_SHARD + 1, numbers // NUMBERS_PER_SHARD + 1)
    graphs = stored(dealt(points, shards).mapInArrow(_build, PIECES), "graphs")
    blocks = count // VECTORS_PER_QUERY_BLOCK + 1
    asked = stored(pack(points, blocks, unit), "queries")
    salts = blocks // QUERY_BLOCKS_PER_TASK + 1
    beam = BEAM
    while True:
        found = in_turn(graphs, everywhere(asked, shards, salts), shards, salts).mapInArrow(_search(beam, cosine), "u long, v long")
        with small_batches(points.sparkSession):
            links = stored(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        parts = stored(components(links), "components")
        more, whole, linked, missed = audited(points, count, graphs, shards, parts, cosine)
        if whole or missed <= (1 - RECALL) * linked or beam >= count:
            return stored(components(parts.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)),
                          "components") if missed else parts
        beam *= 2


def audited(points: DataFrame, count: int, graphs: DataFrame, shards: int, parts: DataFrame, cosine: float):
    """True links (u, v) of a sample that `parts` does not join, whether every class is in the sample, and how many of its
    classes have links and have links not joined."""
    pairs = parts.join(points, "id").groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("block")
                                             ).agg(F.collect_list(F.struct("id", "component")).alias("pairs"))
    labels = stored(pairs.select("dim", "block", F.lit(LABELS).alias("turn"), F.col("pairs.id").alias("nodes"),
                                 F.col("pairs.component").alias("labels")), "labels")
    blocks = graphs.drop("layers").unionByName(labels, allowMissingColumns=True)
    left = parts.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    right = parts.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    # A hash of its own, so that a sample has about its share of every shard.
    place = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    share, before, checked = max(AUDITED / max(count, 1), AUDITED_SHARE), 0.0, None
    while True:
        packs = max(1, int(count * (min(share, 1.0) - before)) // VECTORS_PER_QUERY_BLOCK + 1)
        sample = pack(points.filter((place >= before) & (place < share)), packs, unit)
        salts = packs // QUERY_BLOCKS_PER_TASK + 1
        with small_batches(points.sparkSession):
            true = stored(in_turn(blocks, everywhere(sample, shards, salts), shards, salts)
                          .mapInArrow(_audit(cosine), "u long, v long"), "audit")
        checked = true if checked is None else checked.unionByName(true)
        judged = checked.join(left, "u", "left").join(right, "v", "left").withColumn(
            "missed", F.coalesce("cu", "u") != F.coalesce("cv", "v"))
        linked, missed = judged.groupBy("u").agg(F.max("missed").alias("missed")).agg(
            F.count(F.lit(1)), F.count(F.when(F.col("missed"), 1))).first()
        if linked >= AUDITED_LINKED or share >= 1:
            return judged.filter("missed").select("u", "v"), share >= 1, linked, missed
        before, share = share, share * AUDITED_GROWTH


def count_links(classes: DataFrame, parts: DataFrame, cosine: float) -> DataFrame:
    """node, n: members of other classes that a class is linked with, each copy counted."""
    members = classes.join(parts.withColumnRenamed("id", "node"), "node").select("node", "copies", "component",
                                                                               F.col("vector").cast("array<double>").alias("vector"))
    sizes = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK).cast("int").alias("blocks"))
    own = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = own.select("*", every)
    left = rows.select("component", F.col("own").alias("l"), F.col("other").alias("r"), F.lit(0).alias("side"), "node", "copies", "vector")
    right = rows.select("component", F.col("other").alias("l"), F.col("own").alias("r"), F.lit(1).alias("side"), "node", "copies", "vector")
    return (left.unionByName(right).repartition("component", "l", "r")
            .sortWithinPartitions("component", "l", "r").mapInArrow(_count(cosine), "node long, n long")
            .groupBy("node").agg(F.sum("n").alias("n")))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id (smallest id within reach), kept."""
    # Adding 0 turns -0 into 0, so that equal vectors are equal keys.
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST_ID))).alias("id"),
                          F.transform(F.col(vector_col), lambda x: x + F.lit(0).cast("float")).alias("vector"))
    usable = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("vector")))
    classes = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "classes")
    parts = link_components(classes, cosine)
    counts = count_links(classes, parts, cosine)
    grouped = classes.drop("vector").join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = (grouped.join(smallest, "component").join(counts, "node", "left")
                .select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    found = rows.select("id", "node").join(stored(by_class, "vector-classes"), "node", "left")
    component, none = F.coalesce("component_id", "id"), F.lit(int(LAST_ID))
    return found.select(F.nullif("id", none).alias("id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                        F.nullif(component, none).alias("component_id"), (F.col("id") == component).alias("kept"))


@query("op3_embedding_near_dedup", sql="""
    WITH RECURSIVE v AS (
        SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
        WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
    links AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b
        ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
    ), reach AS (
        SELECT vec_id, vec_id AS c FROM embeddings
        UNION SELECT l.u, r.c FROM reach r JOIN links l ON l.v = r.vec_id
    ), smallest AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
    counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
    SELECT s.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, s.vec_id = component_id AS kept
    FROM smallest s LEFT JOIN counts ON u = s.vec_id
""")
def op3_embedding_near_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
