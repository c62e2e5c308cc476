"""Importing this module registers the queries of all operators."""

from methmix.llm import (  # noqa: F401
    bpe, clustering, embeddings, language, licenses, minhash, mixing, onebit, pages, resampling, sharding, substrings, topk)
from methmix.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
