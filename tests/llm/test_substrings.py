"""Substring dedup against a dictionary of all windows."""

import hashlib

import pytest

from methmix.llm import substrings
from methmix.llm.words import split_words, word_hashes
from tests.llm.data import WORDS, documents, hard_texts, rows, sentence


def removed(data, window):
    """Flags of the words to remove by row; a null id is the largest."""
    words = [WORDS.findall(r[1] or "") for r in data]
    key = [float("inf") if r[0] is None else r[0] for r in data]
    first = {}
    for k, w in zip(key, words):
        for i in range(len(w) - window + 1):
            at = tuple(w[i:i + window])
            first[at] = min(first.get(at, k), k)
    out = []
    for k, w in zip(key, words):
        flags = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < k:
                flags[i:i + window] = [True] * window
        out.append((w, flags))
    return out


@pytest.mark.parametrize("window", [13, 50, 1])
def test_hard_cases(spark, window):
    data = rows(hard_texts())
    expected = {r[0]: flags for r, (_, flags) in zip(data, removed(data, window))}
    found = substrings.removal_intervals(documents(spark, data), window).collect()
    for r in found:
        flags = [False] * len(expected[r["doc_id"]])
        for a, b in r["intervals"]:
            flags[a:b] = [True] * (b - a)
        assert flags == expected[r["doc_id"]]
        assert r["Key"] == "k"


def test_cut_texts_keep_their_layout(spark):
    shared = sentence(1, 20)
    data = rows(["Intro:\n  " + " ".join(shared) + "\n\nend", "Other\t" + "  ".join(shared) + "\n tail .", None, ""])
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(documents(spark, data), 13).collect()}
    assert cut == {0: data[0][1], 1: "Other\ttail .", 2: None, 3: ""}


def test_query_digests(spark, tmp_path):
    data = rows(hard_texts())
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = substrings.op4_substring_dedup(spark, str(tmp_path)).collect()
    expected = {}
    for r, (words, flags) in zip(data, removed(data, 13)):
        kept = [w for w, f in zip(words, flags) if not f]
        expected[r[0]] = (len(words), sum(flags), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected


def test_repeated_and_null_ids(spark):
    text = " ".join(sentence(1, 20))
    data = [(4, text, None, None, 1, "k"), (4, text, None, None, 1, "k"), (None, text, None, None, 1, "k")]
    found = substrings.removal_intervals(documents(spark, data), 13).collect()
    assert sorted((str(r["doc_id"]), len(r["intervals"])) for r in found) == [("4", 0), ("4", 0), ("None", 1)]


def test_empty_table_and_clash(spark):
    empty = documents(spark, [])
    assert substrings.removal_intervals(empty).collect() == []
    clash = substrings.removal_intervals(empty.withColumnRenamed("Key", "Intervals"))
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "intervals"] and clash.collect() == []


def test_long_words_across_pieces(monkeypatch):
    import methmix.llm.words as words
    data = b"ab cde  f " * 50 + b"q" * 40 + b" z"
    whole = data.split()
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(words, "PIECE_BYTES", size)
        assert [w for part in split_words(data) for w in part] == whole
        assert len(word_hashes(data)) == len(whole)
