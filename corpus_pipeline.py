"""The corpus pipeline: five stages, each on all that the one before kept, from raw documents to packed sequences.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import digest_index, gam, near_copies, packing, soft_mixing
from tidemark.llm.common import materialize, read_table
from tidemark.llm.queries import WORD_BPE, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. Features are computed beside the text, so nothing is shuffled."""
    return gam.keep_good(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id."""
    index = digest_index.fresh_index(spark)
    kept = digest_index.drop_duplicates(docs.select(*COLUMNS), index)
    index.drop()  # the decisions are written by then
    return kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of at least 0.8) the document with the smallest id.

    Operator 8's fingerprints and bit-sliced comparison at a radius for that similarity, then exact similarities.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates of at most 1; clean documents keep rate 1, and the others are thinned to their share of what is clean.

    The budget is the one at which the clean domain's target is all that there is of it. A domain of which there is less
    than its target stays as it is.
    """
    return soft_mixing.resample(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"), budget=None, max_rate=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with digests in place of their ids."""
    return packing.piece_digests(packing.pack(docs, tokenizer_path(WORD_BPE)))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("packing", pack),
]

#: SQL can express neither the learned stages nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each materialised in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
