"""A corpus pipeline of five stages: quality, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of docs. Null, empty and repeated rows, ties and clashing columns: as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import exact_dedup, mixing, packing, partenum, quality
from rasterlake.llm.common import cut, table
from rasterlake.llm.queries import held_out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labels of the training folds, doesn't reject."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return quality.keep_good(docs, quality.train(docs, labels))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.exact_dedup(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return partenum.drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences, with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", unique_texts),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    out = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, out, sf_dir)
        if n < len(STAGES):
            out = cut(out)
    return out
