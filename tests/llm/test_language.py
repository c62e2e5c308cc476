"""Held-out accuracy on the test tables, and the hard cases."""

import os

import pytest
from pyspark.sql import functions as F

from methmix.llm import language
from tests.llm.data import documents, hard_texts, rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    found = language.op6_language_id(spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right, count, low, high = found.filter("held_out").join(truth, "doc_id").agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert count > 200 and right >= 0.98 * count and 0 <= low <= high <= 1


def test_held_out_rows_follow_the_rule(spark):
    import zlib
    data = documents(spark, rows(["a"] * 60) + [(None, "a", "en", None, 1, "k")])
    for r in data.select("doc_id", language.held_out("doc_id").alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


LANGS = {"en": "the cat sat on the mat and looked at the moon", "de": "die katze und der hund gehen nicht über die straße",
         "fr": "le chat et la souris sont dans la maison où été", "ru": "кошка и собака идут по улице"}


def trained(spark):
    data = [(i, f"{text} {text.split()[i % 5]}", lang, None, 1, "k") for n, (lang, text) in enumerate(LANGS.items())
            for i in range(n * 100, n * 100 + 20)]
    return language.fit(documents(spark, data + [(None, "x", "fr", None, 1, "k"), (9999, None, "fr", None, 1, "k"), (9998, "x", None, None, 1, "k")]))


def test_hierarchy_and_hard_cases(spark):
    model = trained(spark)
    assert model.families.classes == ["germanic", "romance", "slavic"] and model.within["germanic"].classes == ["de", "en"]
    texts = [*LANGS.values(), *hard_texts(), "123 -- !", "é"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.with_language(documents(spark, rows(texts)), model).collect()}
    assert [found[i][0] for i in range(4)] == list(LANGS)
    for i, text in enumerate(texts):
        letters = any(c.isalpha() for c in text or "")
        assert (found[i] == ("und", 0.0)) != letters
        assert 0 <= found[i][1] <= 1


def test_fit_is_bounded_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 7)
    one, two = trained(spark), trained(spark)
    assert (one.families.weights == two.families.weights).all()
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        trained(spark)


def test_nothing_to_learn_one_language_and_empty(spark):
    docs = documents(spark, rows(["some text", None]))
    nothing = language.fit(docs.filter("doc_id < 0"))
    assert [(r["lang_pred"], r["score"]) for r in language.with_language(docs, nothing).collect()] == [("und", 0.0)] * 2
    one = language.fit(docs)
    assert [r["lang_pred"] for r in language.with_language(docs, one).orderBy("doc_id").collect()] == ["en", "und"]
    assert language.with_language(documents(spark, []), one).collect() == []
    clash = language.with_language(docs.withColumnRenamed("Key", "Score"), one)
    assert "Score" not in clash.columns and clash.count() == 2
