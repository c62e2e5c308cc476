"""Ids and texts against the tokenizers library, and exact merges on random words."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from methmix.llm import bpe
from tests.llm.data import documents, hard_texts, rows, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def same(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_hard_texts(library, own):
    for text in [*hard_texts(), "x<|endoftext|> y<|startoftext|>'s DON'T <|endoftext", "ΑΣ ΣΑΣ İI ﬁ Å é", "a b　c\x1cd",
                 "日本語 текст 12³ ½ 🙂🙂", "'S 'LL we'll", "퟿�"]:
        same(library, own, text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabcdeinorst '-.<|>12éßΣς́\n", max_size=80))
def test_random_texts(library, own, text):
    same(library, own, text)


def test_long_word_takes_linear_time(library, own):
    rng = random.Random(1)
    same(library, own, "".join(rng.choice("aeinrst") for _ in range(30_000)))
    same(library, own, "a" * 50_000)


def test_columns(spark, library):
    data = rows(hard_texts())
    encoded = bpe.encode_texts(documents(spark, data), PATH)
    decoded = {r["doc_id"]: r for r in bpe.decode_tokens(encoded, PATH).collect()}
    for doc_id, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert decoded[doc_id]["token_ids"] == ids and decoded[doc_id]["n_tokens"] == len(ids)
        assert decoded[doc_id]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert decoded[doc_id]["Key"] == "k"


def test_query(spark, library, tmp_path):
    import hashlib
    data = rows(hard_texts())
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.op8_bpe_encode_decode(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in
                  (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert found[doc_id] == (len(ids), *digest)


def test_empty_table_and_clash(spark):
    empty = documents(spark, [])
    assert bpe.encode_texts(empty, PATH).collect() == []
    clash = bpe.encode_texts(documents(spark, rows(["a b"])).withColumnRenamed("Key", "Token_Ids"), PATH)
    assert "Token_Ids" not in clash.columns and clash.first()["n_tokens"] == 2


def test_small_generations_change_nothing(own, monkeypatch):
    """Words leave the store and come back; their tokens stay the same, and the store stays within its bounds."""
    texts = [" ".join(sentence(i % 7, 60)) + f" end-{i}, (w{i}) don't" for i in range(60)]
    whole = [own.encode(t).tolist() for t in texts]
    for kept in (1, 3, 50):
        monkeypatch.setattr(bpe, "CACHED_WORDS", kept)
        monkeypatch.setattr(bpe, "CACHED_CHUNKS", kept)
        own.young, own.old, own.chunks = {}, {}, {}
        assert [own.encode(t).tolist() for t in texts] == whole
        assert len(own.young) <= kept and len(own.old) <= kept and len(own.chunks) <= kept


def test_ended_tasks_give_memory_back(monkeypatch):
    """Slices release what the task allocated, also on the C heap, once the last is taken."""
    import pyarrow as pa
    from methmix.llm import words
    calls = []

    class Heap:
        @staticmethod
        def malloc_trim(pad):
            calls.append(pad)
    monkeypatch.setattr(words.ctypes, "CDLL", lambda name: Heap)
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "b"]})
    assert sum(s.num_rows for s in words.slices(iter([batch]), "text")) == 3 and calls == [0]
