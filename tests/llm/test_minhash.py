"""Near-dedup against all pairs on full shingle sets."""

import random
from itertools import combinations

import pytest

from methmix.llm import components as cc
from methmix.llm import minhash
from tests.llm.data import components, documents, hard_texts, rows, sentence


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def expected(data, width):
    sets = {r[0]: shingles(r[1], width) for r in data}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def got(spark, data, width):
    found = minhash.near_duplicates(documents(spark, data), width).collect()
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}


@pytest.mark.parametrize("width", [2, 5])
def test_hard_cases(spark, width):
    data = rows(hard_texts())
    assert got(spark, data, width) == expected(data, width)


def edited(words, rng, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def test_families_near_the_threshold(spark, monkeypatch):
    """Variants of one text, linked or not, with family chunks and list chunks of a few members."""
    rng = random.Random(3)
    texts = []
    for family in range(3):
        base = sentence(family, 120)
        texts += [" ".join(edited(base, rng, rng.choice([0.02, 0.05, 0.08]))) for _ in range(40)]
    rng.shuffle(texts)
    data = rows(texts)
    assert got(spark, data, 2) == expected(data, 2)
    monkeypatch.setattr(minhash, "FAMILY_CHUNK", 10)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    assert got(spark, data, 2) == expected(data, 2)


def test_null_and_repeated_ids(spark):
    text = " ".join(sentence(1, 30))
    data = [(None, text, None, None, None, "k"), (5, text, None, None, None, "k"), (5, text, None, None, None, "k"),
            (3, "other words here", None, None, None, "k"), (None, None, None, None, None, "k")]
    found = minhash.near_duplicates(documents(spark, data), 2).collect()
    assert sorted((str(r["id"]), str(r["component_id"]), r["kept"]) for r in found) == [
        ("3", "3", True), ("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_empty_table_and_dropping(spark):
    assert minhash.near_duplicates(documents(spark, []), 2).collect() == []
    data = rows(hard_texts())
    kept = {i for i, v in expected(data, 5).items() if v[2]}
    left = minhash.drop_near_duplicates(documents(spark, data), 5)
    assert left.columns == documents(spark, data).columns
    assert {r["doc_id"] for r in left.collect()} == kept


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    found = cc.components(spark.createDataFrame(chain, "u long, v long"))
    assert {r["id"]: r["component"] for r in found.collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert cc.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies_whose_lists_are_split(spark, monkeypatch):
    """The only link of a family of two holds, wherever its ends are dealt to."""
    monkeypatch.setattr(minhash, "CHUNK", 1)
    texts = []
    for family in range(12):
        base = sentence(family, 120)
        texts += [" ".join(base), " ".join(base[:60] + ["changed"] + base[61:])]
    data = rows(texts)
    assert got(spark, data, 2) == expected(data, 2)
