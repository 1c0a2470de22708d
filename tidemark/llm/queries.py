"""The queries of this subpackage, as ``queries()`` and ``oracle_sql()`` of the driver's entry point name them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format,
    decision_list,
    digest_index,
    gam,
    license_scan,
    lm_scoring,
    oracles,
    packing,
    simhash,
    soft_mixing,
    token_count,
)
from .common import read_table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = decision_list.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return packing.piece_digests(packed)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digests(chat_format.format_chats(turns))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarise(license_scan.scan(read_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digest_index.fresh_index(spark)
    found = digest_index.deduplicate(read_table(spark, sf_dir, "documents"), index, n_batches=2)
    index.drop()
    return found


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_chat_format": op4_chat_format,
    "op5_license_scan": op5_license_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op4_chat_format": oracles.CHAT_FORMAT,
    "op7_exact_dedup": oracles.EXACT_DEDUP,
}
