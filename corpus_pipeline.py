"""A training-data pipeline over `documents`: five stages, each written and read again as Parquet.

Every stage but the last takes documents and returns documents: the classifier rejects
junk, the join keeps one document of each group of near copies, repeated passages are cut
out, sources are mixed to their weights (which repeats documents), and what is left is
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import crf, mixing, ngram_join, packing, suffix
from quire.llm.common import Workspace, read

#: Shingle words and percent of the union from which documents are near copies.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored below the threshold go."""
    return crf.keep_good(docs, crf.fit(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies stays."""
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of 100 bytes and more that start earlier in the corpus are cut out."""
    return suffix.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources are repeated or thinned to their weights."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixture),
    ("packing", sequences),
]

#: SQL expresses neither the classifier nor the join on whole tables; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    space = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
