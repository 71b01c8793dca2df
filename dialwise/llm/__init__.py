"""Operators for preparing language-model training text, as Spark jobs."""

from dialwise.llm import common
from dialwise.llm import chat, classifier, decontaminate, hostrules, lattice, licenses, neardup, ngrams, rtree, substring, tokencount, tokenfiles, trie  # noqa: F401

QUERIES = common.QUERIES
ORACLES = common.ORACLES
