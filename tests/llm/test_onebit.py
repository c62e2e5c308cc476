"""One-bit code search against comparison with all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from methmix.llm import onebit
from tests.llm.test_vectors import usable, vectors

KIND = "vec_id long, embedding array<double>, label int"


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def best(data, k):
    good = [(i, [float(x) for x in v]) for i, v, _ in data if i is not None and usable(v) and any(v)]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-in_order(w, v) / (math.sqrt(in_order(v, v)) * math.sqrt(in_order(w, w))), i)
                        for i, w in good if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def search(spark, data, k=5):
    rows = spark.createDataFrame(data, KIND).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return sorted(map(tuple, onebit.nearest(rows.filter("id % 50 = 0"), rows, k).collect()))


@pytest.mark.parametrize("block", [8192, 29])
def test_against_all(spark, monkeypatch, block):
    """Families, copies, ties, every unusable kind, two dimensions."""
    monkeypatch.setattr(onebit, "VECTORS_PER_BLOCK", block)
    monkeypatch.setattr(onebit, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(onebit, "QUERY_BLOCKS_PER_TASK", 1)
    data = vectors(5, 400)
    assert search(spark, data) == best(data, 5)


def test_few_candidates_ids_and_empty(spark):
    data = [(None, [1.0, 1.0], 0), (0, [2.0, 1.0], 0), (0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (50, [3.0], 0)]
    assert search(spark, data) == best(data, 5) and len(best(data, 5)) == 2
    assert search(spark, []) == []
    copies = [(i, [1.0, 0.0, 1.0], 0) for i in range(101)]
    assert search(spark, copies) == best(copies, 5)


def test_components_whose_squares_leave_the_range(spark):
    data = [(0, [3e200, 4e200], 0), (1, [3e-200, 4e-200], 0), (2, [1.0, 0.0], 0), (3, [-1e300, 0.0], 0)]
    found = search(spark, data)
    assert [(r[0], r[2]) for r in found] == [(0, 1), (0, 2), (0, 3)]
    assert [r[3] for r in found] == pytest.approx([1.0, 0.6, -0.6], abs=1e-15)


def near_of_all(x, asked, k):
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    return np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("dim,centres", [(64, 4000), (24, 30), (200, 400)])
def test_recall_and_share_ranked(dim, centres):
    """Without and with structure: recall near 1 while most candidates are passed over."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, 4000)] + 0.5 * rng.normal(size=(4000, dim))
    x = onebit.unit(x)
    codes, corners = onebit.encode(x)
    block = onebit.Block(np.arange(4000).tobytes(), x.tobytes(), codes.tobytes(), corners.tobytes(), dim)
    asked = np.arange(0, 4000, 40)
    found = [block.near(int(q), x[q], 5, -np.inf) for q in asked]
    true = near_of_all(x, asked, 5)
    assert np.mean([len(set(f[0].tolist()) & set(t.tolist())) / 5 for f, t in zip(found, true)]) > 0.999
    assert np.mean([f[2] for f in found]) < 0.35 * 4000


def test_bounds():
    """The estimate is the true product but for an error that its bound covers."""
    rng = np.random.default_rng(3)
    x, q = onebit.unit(rng.normal(size=(5000, 64))), onebit.unit(rng.normal(size=(20, 64)))
    codes, corners = onebit.encode(x)
    errors, outside = [], 0
    for one in q:
        estimate, error = onebit.Question(one).bounds(codes, corners)
        errors.append(estimate - x @ one)
        outside += (np.abs(errors[-1]) > error).sum()
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.06
    assert outside <= 20 * 5000 * 2e-4
    turned = np.where(np.unpackbits(codes[:3].view(np.uint8), axis=1, bitorder="little") == 1, 1, -1) / 16
    rounded = onebit.Question(q[0])
    steps = sum(np.unpackbits(p.view(np.uint8), bitorder="little").astype(int) << n for n, p in enumerate(rounded.planes))
    assert rounded.products(codes[:3]) == pytest.approx(turned @ (rounded.low + rounded.step * steps))


def test_a_block_reaches_its_search_once(spark, monkeypatch):
    """Not again with each block of queries."""
    monkeypatch.setattr(onebit, "QUERIES_PER_BLOCK", 1)
    sent, task = spark.sparkContext.accumulator(0), onebit._search

    def watched(k):
        def run(batches):
            def passed():
                for batch in batches:
                    sent.add(batch.nbytes)
                    yield batch
            return task(k)(passed())
        return run

    monkeypatch.setattr(onebit, "_search", watched)
    data = vectors(7, 400)
    assert search(spark, data) == best(data, 5)
    # One block of about 62 kB, met twice; 9 blocks of queries.
    assert 0 < sent.value < 300_000, sent.value
