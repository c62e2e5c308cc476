"""Targets against water-filling in Python, draws against the laws of the mix."""

import os

import pytest

from methmix.llm import mixing
from tests.llm.data import WORDS, documents, hard_texts, rows


def targets(sizes, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        weights = sum(w for s, w in weight.items() if s not in capped)
        share = {s: limit * sizes[s] if s in capped else left * weight[s] / weights for s in order}
        over = {s for s in order if s not in capped and share[s] > limit * sizes[s]}
        if not over:
            return share
        capped |= over


def check(spark, data):
    found = mixing.mix_sources(documents(spark, data)).collect()
    assert len(found) == len(data)
    sizes, taken, largest = {}, {}, {}
    for r in found:
        assert r["size"] == len(WORDS.findall(r["text"] or ""))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    expected = targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s]
    return {r["doc_id"]: r["copies"] for r in found}


def test_hard_cases_and_reruns(spark):
    texts = hard_texts()
    data = rows(texts, sources=[None, "b", "a", "é", "Z"] * 4)
    first = check(spark, data)
    assert check(spark, list(reversed(data))) == first


def test_limits_bind(spark):
    """A heavy weight on tiny sources: they stop at three times their size, the rest is shared anew."""
    texts = ["w " * 1000] * 20 + ["w"] * 3 + ["w w"] * 2
    sources = ["a"] * 20 + ["b"] * 3 + ["c"] * 2
    data = rows([t + str(i) for i, t in enumerate(texts)], sources=sources)
    copies = check(spark, data)
    assert all(copies[i] == 3 for i in range(20, 25))


def test_targets_are_met_closely(spark):
    texts = [f"w{i} " * (i % 5 + 1) for i in range(3000)]
    data = rows(texts, sources=[f"s{i % 7}" for i in range(3000)])
    check(spark, data)


def test_no_words_empty_table_and_clash(spark):
    check(spark, rows([None, "", " "]))
    assert mixing.mix_sources(documents(spark, [])).collect() == []
    clash = mixing.mix_sources(documents(spark, rows(["a b"])).withColumnRenamed("Key", "TARGET"))
    assert "TARGET" not in clash.columns and clash.first()["target"] == 2.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, taken = {}, {}
    for r in docs.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
    expected = targets(sizes)
    found = mixing.op2_mix_sources(spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        source, size = docs[r["doc_id"]]["source"], len(WORDS.findall(docs[r["doc_id"]]["text"] or ""))
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and r["target"] == pytest.approx(expected[source])
        assert 0 <= r["taken"] <= 3 * size
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - expected[source]) <= max(len(WORDS.findall(d["text"] or "")) for d in docs.values() if d["source"] == source)


def test_a_level_of_the_histogram_reads_the_sizes_once(spark, monkeypatch):
    """Each level is a plan of the driver; two joins, with the state and back to it, and one scan of the sizes are enough."""
    plans = []

    def recorded(df, name):
        if name == "mix-state":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    stored = mixing.stored
    monkeypatch.setattr(mixing, "stored", recorded)
    check(spark, rows(["w " * (n % 7) + str(n) for n in range(60)], sources=["a", None, "b"] * 20))
    assert len(plans) == mixing.BANDS * mixing.HASH_BITS // mixing.LEVEL_BITS
    scans = [[line for line in plan.splitlines() if "Relation [" in line and "__llm_hash" in line] for plan in plans]
    assert all(plan.count("Join ") == 2 and len(found) == 1 for plan, found in zip(plans, scans))
