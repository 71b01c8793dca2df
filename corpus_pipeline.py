"""From raw documents to token ids: good documents, one of each near-duplicate group, no repeated
passages, no benchmark text, encoded.

Every stage takes what its predecessor kept and reads it back from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.llm import classifier, decontaminate, lattice, neardup, substring
from dialwise.llm.common import store, table
from dialwise.llm.pieces import model_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of this input, does not reject."""
    return classifier.keep_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def first_occurrences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; ``n_chars`` follows the text."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids``."""
    return lattice.encode(docs, model_path()).select("doc_id", F.size("ids").alias("n_ids"), "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", one_of_each),
    ("substring dedup", first_occurrences),
    ("benchmark decontamination", clean_of_benchmarks),
    ("sentencepiece encoding", token_ids),
]

#: no SQL has the classifier, the sketches or the encoder
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        kept = stage(spark, kept, sf_dir)
        if number + 1 < len(STAGES):
            kept = store(kept)
    return kept
