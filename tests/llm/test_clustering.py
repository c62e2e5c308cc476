"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from methmix.llm import clustering

KIND = "vec_id long, embedding array<float>, id int"


def plain(data, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, _ in data
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = nearest()
        for n in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if members:
                centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    own = nearest()
    top = 2**63 - 1
    return sorted((str(i), c, min(d, top), min(sum(e for e, o in own if o == c), top), min(sum(e for e, _ in own), top),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own))


def clustered(spark, data, **settings):
    found = clustering.cluster_vectors(spark.createDataFrame(data, KIND), **settings)
    assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def vectors(seed, count, dim, centres=5):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(centres, dim))[rng.integers(0, centres, count)] + rng.normal(size=(count, dim)) * 0.4).astype(np.float32)
    x[count // 2:count // 2 + 5] = x[0]
    data = [(i, row.tolist(), 0) for i, row in enumerate(x)]
    bad = [None, [], [1.0] * (dim + 1), [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1)]
    return data + [(count + i, v, 0) for i, v in enumerate(bad)] + [(0, data[0][1], 0), (None, data[1][1], 0), (None, [0.0] * dim, 0)]


@pytest.mark.parametrize("k,rounds", [(8, 6), (1, 2), (40, 3)])
def test_against_plain(spark, monkeypatch, k, rounds):
    monkeypatch.setattr(clustering, "VECTORS_PER_PART", 50)
    monkeypatch.setattr(clustering, "PARTS_PER_TASK", 2)
    data = vectors(k, 300, 6)
    assert clustered(spark, data, clusters=k, rounds=rounds, dimension=6) == plain(data, k, rounds, 6)


def test_ties_few_vectors_and_empty(spark):
    # Whole grids of equal distances, and clusters that lose all their vectors.
    data = [(i, [float(i % 3), float(i % 2)], 0) for i in range(30)]
    assert clustered(spark, data, clusters=8, rounds=4, dimension=2) == plain(data, 8, 4, 2)
    assert clustered(spark, data[:3], clusters=8, rounds=2, dimension=2) == plain(data[:3], 8, 2, 2)
    assert clustered(spark, data[:3], clusters=8, rounds=0, dimension=2) == plain(data[:3], 8, 0, 2)
    assert clustered(spark, [], dimension=2) == []


def test_huge_components(spark):
    """Parts with and without components beyond 64 bits, and distances beyond a long."""
    data = [(i, np.float32([i, 3e38 if i == 7 else 1, -2e30 if i == 9 else 1e8 * (i % 2)]).tolist(), 0) for i in range(60)]
    assert clustered(spark, data, clusters=5, rounds=3, dimension=3) == plain(data, 5, 3, 3)


def test_bounds_hold_and_spare_comparisons(monkeypatch):
    """Round after round, the bounds enclose the true distances, and most vectors are not searched."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (rng.normal(size=(10, 4))[rng.integers(0, 10, 2000)] * 3 + rng.normal(size=(2000, 4)) * 0.3)).astype(np.int64)
    searched, plain_search = [], clustering.search
    monkeypatch.setattr(clustering, "search", lambda v, *rest: searched.append(len(v)) or plain_search(v, *rest))
    now, state = clustering.Centroids(x[:10].tolist()), None
    for _ in range(12):
        state = clustering.assign(x, int(np.abs(x).max()), state, now)
        d = np.sqrt(((x[:, None, :] - now.array) ** 2).sum(axis=2))
        first = d[np.arange(2000), state["first"]]
        assert (first == d.min(axis=1)).all() and (state["upper"] >= first).all()
        d[np.arange(2000), state["first"]] = np.inf
        assert (state["lower"] <= d.min(axis=1)).all()
        now = clustering.Centroids([[int(v) // max(int((state["first"] == c).sum()), 1) for v in x[state["first"] == c].sum(axis=0)]
                                    for c in range(10)], now)
    assert searched[0] > 1500 and sum(searched[-3:]) < 600


def test_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    """A round's join reads two tables with the same buckets."""
    plans, plain_bucketed = [], clustering.bucketed
    monkeypatch.setattr(clustering, "VECTORS_PER_PART", 20)
    monkeypatch.setattr(clustering, "PARTS_PER_TASK", 2)
    monkeypatch.setattr(clustering, "bucketed", lambda df, name, n: plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
                        or plain_bucketed(df, name, n))
    clustering.cluster_vectors(spark.createDataFrame(vectors(1, 300, 4), KIND), rounds=3, dimension=4)
    rounds = [plan for name, plan in plans if name == "state"]
    assert len(rounds) == 3 and all("SortMergeJoin" in plan and "Exchange" not in plan for plan in rounds[1:])


def test_limbs():
    for sums in ([1 << 70, -(1 << 70), 5], [-1, 0, 1], [1 << 63, -(1 << 63), 0]):
        parts = list(clustering.limbs(sums))
        assert [sum(part[i] << (clustering.LIMB_BITS * n) for n, part in enumerate(parts)) for i in range(3)] == sums
        assert all(-2**63 <= x < 2**63 for part in parts for x in part)
