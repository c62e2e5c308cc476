"""A training corpus from `documents`: stages that each apply one operator to all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its docs. A
null text has no letter and leaves with the first stage; empty and very long texts, repeated rows and empty
tables are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methmix.llm import bpe, language, minhash, mixing, substrings
from methmix.llm.common import free_name, stored, table

# A repeated passage is at least so many words long; shorter repeats are common phrases of clean documents.
PASSAGE_WORDS = 50
SHINGLE_WORDS = 5


def _renamed(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns of these names, which an operator makes, set aside; and how to name them again."""
    aside = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(aside), {v: k for k, v in aside.items()}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the language found in each text into lang, and drops documents in which none can be: those without any letter.

    Where no row has a language to learn from, all documents stay as they are.
    """
    model = language.fit(docs.filter(~language.held_out("doc_id")))
    if model.families is None:
        return docs
    inner, back = _renamed(docs, language.MADE)
    found = language.with_language(inner, model).filter(F.col("lang_pred") != language.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).drop(*language.MADE).withColumnsRenamed(back).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest id; shingles of five words, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, SHINGLE_WORDS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document with a smaller id has, too; n_chars follows the text."""
    cut = substrings.cut_repeats(docs, PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: not at all, once, or up to three times."""
    inner, back = _renamed(docs, mixing.MADE)
    mixed = mixing.mix_sources(inner).filter("copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")
    return mixed.select("*", copy).drop("_copy", *mixing.MADE).withColumnsRenamed(back).select(docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, decoded."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_and_decode(docs.select("doc_id", "source", "text"), path).drop("text")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode_and_decode),
]

# The language model and the merge table have no SQL form; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
