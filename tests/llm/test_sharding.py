"""Counts, slots and groups of the shards."""

import os
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from methmix.llm import sharding
from tests.llm.data import documents, hard_texts, rows


def place(spark, data, shards):
    docs = documents(spark, data)
    return sharding.shard_documents(docs, F.sha2(F.coalesce("text", F.lit("")), 256), ["doc_id", "text"], shards).collect()


def check(found, data, shards):
    assert len(found) == len(data)
    counts = Counter(r["shard"] for r in found)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    groups = {}
    for r in found:
        groups.setdefault(r["text"] or "", []).append(r["shard"])
    return {t: (len(s), len(set(s))) for t, s in groups.items()}


def test_hard_cases(spark):
    data = rows(hard_texts()) + rows(hard_texts())[:8]
    groups = check(place(spark, data, 4), data, 4)
    assert all(parts == 1 for n, parts in groups.values() if n > 1)


def test_hot_group_takes_as_few_shards_as_it_can(spark):
    texts = ["hot"] * 200 + [f"pair {i // 2}" for i in range(100)] + [f"single {i}" for i in range(300)]
    data = rows(texts)
    groups = check(place(spark, data, 20), data, 20)
    assert groups["hot"][1] <= 9  # 30 rows a shard: 7 at least
    assert sum(parts > 1 for t, (_, parts) in groups.items() if t.startswith("pair")) <= 3


def test_all_linked_fewer_rows_than_shards_and_empty(spark):
    data = rows(["same"] * 50)
    check(place(spark, data, 7), data, 7)
    data = rows(["a", "b"])
    found = place(spark, data, 5)
    assert sorted(r["slot"] for r in found) == [0, 0]
    assert place(spark, [], 5) == []


def test_reruns_agree_and_clash(spark):
    data = rows([f"t{i // 3}" for i in range(90)])
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in place(spark, data, 6)}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in place(spark, data[::-1], 6)}
    assert one == two
    clash = sharding.shard_documents(documents(spark, data).withColumnRenamed("Key", "Slot"), F.col("text"), ["doc_id"])
    assert "Slot" not in clash.columns and clash.count() == 90


def test_cut_edges(spark):
    data = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 2), (None, 1)], "g string, shard int")
    assert tuple(sharding.cut_edges(data, "g").first()) == (2, 1)


def fewest_cuts(sizes, rows, shards):
    """Cut links of the best placement of groups of these sizes among `rows` rows in shards whose counts differ by at most one, over
    all ways to place them."""
    start = tuple(sorted(rows // shards + (s < rows % shards) for s in range(shards)))

    @lru_cache(None)
    def parts(group, left, room):
        if left == 0:
            return 0 if group + 1 == len(sizes) else parts(group + 1, sizes[group + 1], room)
        return min(1 + parts(group, left - take, tuple(sorted(room[:i] + (free - take,) + room[i + 1:])))
                   for i, free in enumerate(room) for take in range(1, min(free, left) + 1))
    return parts(0, sizes[0], start) - len(sizes)


@pytest.mark.parametrize("sizes, singles, shards", [((5, 3, 3, 2, 2), 10, 3), ((9, 2, 2, 2), 15, 5)])
def test_near_the_best_placement(spark, sizes, singles, shards):
    """Where documents without links leave room to move; a table of links alone has none."""
    data = rows([f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(singles)])
    groups = check(place(spark, data, shards), data, shards)
    found, best = sum(parts - 1 for _, parts in groups.values()), fewest_cuts(sizes, len(data), shards)
    assert best <= found <= best + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = sharding.op5_shard_documents(spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
    check([{**r.asDict(), "text": texts[r["doc_id"]]} for r in found], texts, 40)
