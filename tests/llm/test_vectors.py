"""Searches over vectors against comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from methmix.llm import embeddings, hnsw, topk
from tests.llm.data import components

KIND = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, count=300, dim=16):
    """Random vectors with families, exact copies and every unusable kind."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, dim)).astype(np.float32)
    for i in range(0, count, 5):
        x[i] = x[i - i % 25] + rng.normal(size=dim).astype(np.float32) * 0.08
    x[7] = x[3]
    x[8] = 2 * x[3]
    data = [(i, [float(c) for c in row], 0) for i, row in enumerate(x)]
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [-0.0] * dim]
    data += [(count + i, v, 0) for i, v in enumerate(bad)]
    return data + [(1000, [1.0, 2.0], 0), (1001, [2.0, 4.0], 0)]


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def links_of(data):
    good = {i: np.array(v, np.float64) for i, v, _ in data if usable(v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    ids = sorted(unit)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]


def check_links(spark, data):
    links = links_of(data)
    found = components([i for i, _, _ in data], links)
    counts = {i: sum(i in pair for pair in links) for i, _, _ in data}
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(data, KIND)).collect()
    assert {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (counts[i], found[i], found[i] == i) for i, _, _ in data}


def test_links(spark):
    check_links(spark, vectors())


def test_links_with_small_blocks_and_a_narrow_beam(spark, monkeypatch):
    """The audit widens a beam that finds too little."""
    monkeypatch.setattr(embeddings, "BEAM", 1)
    monkeypatch.setattr(embeddings, "COUNT_BLOCK", 3)
    check_links(spark, vectors(1))


def test_repeated_and_null_ids_and_empty(spark):
    data = [(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, None, 0)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(data, KIND)).collect()
    assert sorted((str(r["id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("2", 0, "2", True), ("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", True), ("None", 2, "4", False)]
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], KIND)).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph.from_bytes(x, hnsw.Graph.build(x).to_bytes())
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :5]
    nodes, _ = graph.search(x[:300], 64)
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(nodes, true)]) > 0.9
    exact, _ = graph.search(x[:300], 3000)
    assert (exact[:, 0] == np.arange(300)).all()


def best(data, k, queries):
    whole = {}
    for i, v, _ in data:
        if usable(v):
            whole[i] = [int(np.floor(64 * float(c))) for c in v]
    out = []
    for q in sorted(whole):
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def search(spark, data, k):
    rows = spark.createDataFrame(data, KIND).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return sorted(tuple(r) for r in topk.top_k(rows.filter("id % 20 = 0"), rows, k).collect())


@pytest.mark.parametrize("size", [16_384, 37])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", size)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    data = vectors(3)
    assert search(spark, data, 20) == best(data, 20, lambda i: i % 20 == 0)


def test_top_k_ties_few_candidates_and_huge_values(spark):
    data = [(i, [1.0, float(i % 2)], 0) for i in range(30)]
    assert search(spark, data, 5) == best(data, 5, lambda i: i % 20 == 0)
    data = [(0, [1.0], 0), (1, [2.0], 0)]
    assert search(spark, data, 5) == [(0, 1, 1, 8192)]
    data = [(0, [1e7, 3.0], 0), (1, [1e7, 2.0], 0), (2, [1e7, 5.0], 0), (3, [1e30, 1.0], 0)]
    expected = [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in best(data, 5, lambda i: i % 20 == 0)]
    assert search(spark, data, 5) == expected


def test_top_k_null_ids_and_empty(spark):
    data = [(None, [1.0, 1.0], 0), (0, [1.0, 1.0], 0), (0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0)]
    assert search(spark, data, 5) == [(0, 1, 1, 8192), (0, 2, 1, 8192)]
    assert search(spark, [], 5) == []


def test_few_links_are_found_though_the_graphs_find_none(spark, monkeypatch):
    """No search result at all: with few links, the audit must go on to every class."""
    monkeypatch.setattr(embeddings, "_search", lambda beam, cosine: lambda batches: (batch.slice(0, 0) for batch in ()))
    monkeypatch.setattr(embeddings, "AUDITED", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    x[150:156] = x[20:26] + rng.normal(size=(6, 16)) * 0.01
    check_links(spark, [(i, [float(c) for c in row], 0) for i, row in enumerate(x.astype(np.float32))])


def test_audit_of_a_part(spark, monkeypatch):
    """A sample that has links enough stops, and a narrow beam is widened until it passes."""
    monkeypatch.setattr(embeddings, "AUDITED", 150)
    monkeypatch.setattr(embeddings, "AUDITED_LINKED", 10)
    monkeypatch.setattr(embeddings, "BEAM", 1)
    check_links(spark, vectors(1))


def test_a_shard_reaches_its_search_once(spark, monkeypatch):
    """Not again with each block of queries, which had let tasks run out of memory. Links stay whole."""
    monkeypatch.setattr(embeddings, "VECTORS_PER_QUERY_BLOCK", 8)
    monkeypatch.setattr(embeddings, "AUDITED", 40)
    sent, search = spark.sparkContext.accumulator(0), embeddings._search

    def watched(beam, cosine):
        task = search(beam, cosine)

        def run(batches):
            def passed():
                for batch in batches:
                    sent.add(batch.nbytes)
                    yield batch
            return task(passed())
        return run

    monkeypatch.setattr(embeddings, "_search", watched)
    check_links(spark, vectors(6))
    # About 80 kB of shards with their links and 240 kB of queries; joined, the shards come 8 times.
    assert 0 < sent.value < 500_000, sent.value


def test_a_shard_in_pieces(monkeypatch):
    """Pieces of a shard are small, and together they are the shard."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([16] * 300, pa.int32()), pa.array([0] * 200 + [6] * 100, pa.int32()), pa.array(range(300), pa.int64()),
         pa.array(list(x), pa.list_(pa.float64()))], names=["dim", "block", "id", "vector"])
    monkeypatch.setattr(embeddings, "PIECE_BYTES", 2048)
    # Rows come in batches of any size.
    rows = [r for b in embeddings._build(iter([batch.slice(0, 70), batch.slice(70, 0), batch.slice(70)])) for r in b.to_pylist()]
    assert [(r["block"], r["turn"]) for r in rows] == [(0, t) for t in range(13)] + [(6, t) for t in range(7)]
    assert max(len(r["vectors"]) for r in rows) == 2048
    ids, exact, graph = embeddings._shard(rows[:13])
    whole = hnsw.Graph.build(embeddings.unit(x[:200]).astype(np.float32))
    assert (ids == np.arange(200)).all() and (exact == embeddings.unit(x[:200])).all()
    assert all((a == b).all() for a, b in zip(graph.layers, whole.layers, strict=True))
