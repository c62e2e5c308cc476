"""Each stage of the pipeline against its plain version, and the whole run."""

import re

import pytest

import corpus_pipeline
from methmix.llm import language, mixing
from tests.llm.data import documents, hard_texts, rows, sentence
from tests.llm.test_minhash import expected
from tests.llm.test_substrings import removed


@pytest.fixture(scope="module")
def data():
    passage = sentence(50, 70)
    more = [" ".join(sentence(60 + i, 30) + passage + sentence(80 + i, 30)) for i in range(3)]
    texts = hard_texts() + more + ["123 456 !!", "clean and short", "clean, too"]
    return rows(texts, langs=["en", "de", None] * (len(texts) // 3) + ["fr"] * (len(texts) % 3))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_drops_texts_without_letters(spark, data):
    docs = documents(spark, data)
    kept = by_id(corpus_pipeline.identify_language(spark, docs, ""))
    assert set(kept) == {r[0] for r in data if any(c.isalpha() for c in r[1] or "")}
    model = language.fit(docs.filter(~language.held_out("doc_id")))
    found = {r["doc_id"]: r["lang_pred"] for r in language.with_language(docs, model).collect()}
    for i, text, _, source, n_chars, key in data:
        if i in kept:
            assert tuple(kept[i]) == (i, text, found[i], source, n_chars, key)


def test_language_keeps_all_where_nothing_can_be_learned(spark, data):
    docs = documents(spark, [(*r[:2], None, *r[3:]) for r in data])
    assert sorted(map(tuple, corpus_pipeline.identify_language(spark, docs, "").collect())) == sorted(map(tuple, docs.collect()))


def test_near_duplicates_judge_rows_by_their_own_text(spark):
    """Rows repeated in full are one; a clean text that shares the id of a copy stays."""
    one, two, three = (" ".join(sentence(s, 40)) for s in (1, 2, 3))
    docs = documents(spark, [(i, t, "en", "s", 1, "k") for i, t in
                             [(0, one), (1, one), (1, two), (2, three), (2, three), (2, three), (None, None), (None, None), (3, ""), (3, "")]])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted(
        [("0", one), ("1", two), ("2", three), ("None", "None"), ("3", "")])


def test_near_duplicates_keep_one_of_each_group(spark, data):
    kept = by_id(corpus_pipeline.drop_near_duplicates(spark, documents(spark, data), ""))
    assert set(kept) == {i for i, (_, _, keep) in expected(data, 5).items() if keep}


def test_passages_are_cut_and_clean_texts_kept(spark, data):
    found = by_id(corpus_pipeline.cut_repeated_passages(spark, documents(spark, data), ""))
    for r, (words, flags) in zip(data, removed(data, 50)):
        text = found[r[0]]["text"]
        if not any(flags):
            assert text == r[1]
        else:
            assert re.findall(r"[^\x20\x09-\x0D]+", text) == [w for w, f in zip(words, flags) if not f]
        assert found[r[0]]["n_chars"] == (None if text is None else len(text))


def test_mixing_repeats_and_drops(spark, data):
    docs = documents(spark, data)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    taken = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert sorted(taken) == sorted(i for i, c in copies.items() for _ in range(c))


def test_encoding_matches_the_library(spark, data):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(corpus_pipeline.encode_and_decode(spark, documents(spark, data), ""))
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert found[r[0]]["token_ids"] == ids and found[r[0]]["n_tokens"] == len(ids)
        assert found[r[0]]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_clashing_columns_pass_through(spark, data):
    docs = documents(spark, data).withColumnsRenamed({"Key": "Score"}).selectExpr("*", "doc_id as copies", "'x' as lang_pred", "1 as _cut")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, "")
        assert docs_after.columns == docs.columns
        assert all(r["copies"] == r["doc_id"] and r["Score"] == "k" for r in docs_after.collect())


def test_whole_run_and_empty_table(spark, data, tmp_path):
    documents(spark, data).write.parquet(f"{tmp_path}/a/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert found and {r["doc_id"] for r in found} <= {r[0] for r in data}
    documents(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
