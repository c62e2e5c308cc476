"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from methmix.llm import resampling
from tests.llm.data import documents, hard_texts, rows, sentence


def features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def plain(docs, target, percent, buckets, longest, least):
    """(id, n_features, weight, score, rank), sorted."""
    made = [(i, *features(t, longest)) for i, t in docs]
    s = Counter(h % buckets for _, _, f in made for h in f)
    t = Counter(h % buckets for text in target for h in features(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    scored = []
    for id_, words, found in made:
        weight = sum(gain[h % buckets] for h in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        scored.append((id_, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [(r[0], r[2], r[3], r[4], n) for n, r in enumerate(able[:len(able) * percent // 100], 1)]
    rest = [(r[0], r[2], r[3], r[4], None) for r in able[len(drawn):] + [r for r in scored if r[1] < least]]
    return sorted(drawn + rest, key=str)


def resample(spark, texts, ids, target, **settings):
    docs = documents(spark, [(i, *row[1:]) for i, row in zip(ids, rows(texts))])
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.importance_resample(docs, goal, **settings)
    assert found.columns == ["id", "n_features", "weight", "score", "rank"]
    return docs, found


@pytest.mark.parametrize("longest,percent,pivots,shrink", [(1, 10, 15, 4), (3, 50, 1, 1), (2, 100, 2, 1000)])
def test_against_plain(spark, monkeypatch, longest, percent, pivots, shrink):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    monkeypatch.setattr(resampling, "SHRINK", shrink)
    texts = [*hard_texts(), "\0 nul A-Z[x]{y}~\x7f é9", *(" ".join(sentence(s, 25 + s)) for s in range(40))]
    ids = list(range(len(texts)))
    target = [" ".join(sentence(3, 50)), None, "", " ".join(sentence(7, 20))]
    _, found = resample(spark, texts, ids, target, longest=longest, percent=percent)
    assert sorted(map(tuple, found.collect()), key=str) == plain(list(zip(ids, texts)), target, percent, 10_000, longest, 20)


def test_repeated_and_null_ids(spark):
    """Rows equal in every respect share a score; as many of them are drawn as fit."""
    texts = [" ".join(sentence(1, 30))] * 30 + [" ".join(sentence(2, 30)), " ".join(sentence(2, 40))] * 3
    ids = [None] * 5 + [4] * 20 + [None] * 5 + [4, None] * 3
    docs, found = resample(spark, texts, ids, [" ".join(sentence(2, 30))], percent=40)
    assert sorted(map(tuple, found.collect()), key=str) == plain(list(zip(ids, texts)), [" ".join(sentence(2, 30))], 40, 10_000, 1, 20)
    drawn = resampling.drawn_documents(docs, found)
    assert drawn.columns == docs.columns and drawn.count() == sum(i == 4 for i in ids)


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"it's \\{i}", " ".join(sentence(i, 30))) for i in range(50)], "doc_id string, text string")
    ranks = [r["rank"] for r in resampling.importance_resample(docs, docs.limit(3), percent=30).orderBy("rank").collect() if r["rank"]]
    assert ranks == list(range(1, 16))


def test_empty(spark):
    _, found = resample(spark, [], [], ["a b"])
    assert found.collect() == []
    _, found = resample(spark, ["a " * 30, None], [1, 2], [], percent=50)
    assert [r["rank"] for r in found.orderBy("id").collect()] == [None, None]


def test_long_text_in_pieces(monkeypatch):
    from methmix.llm import words
    text = " ".join(sentence(9, 500)).encode()
    monkeypatch.setattr(words, "PIECE_BYTES", 37)
    pieces = [h for _, hashes in resampling.feature_hashes(text, 3) for h in hashes.tolist()]
    assert sorted(pieces) == sorted(features(text.decode(), 3)[1])
