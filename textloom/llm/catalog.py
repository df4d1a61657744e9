"""The subpackage's registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_collapse, chat_repair, exact_dedup, lexical_search, line_quality, packing, parity_join, pii, repeats, token_counts, toxicity, winnow
from .common import table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_entities")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents")).select(*line_quality.COLUMNS)


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_components(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"))


def op5_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(table(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), passage=51)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_repair.reports(chat_repair.damaged(turns), turns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_surrogates, op2_line_frequency, op3_parity_join, op4_bpe_codec, op5_chat_collapse, op6_token_counts, op7_toxicity, op8_winnowing, op9_repeats, op10_harmonic_packing,
        op11_conversation_repair, op12_exact_dedup, op13_ranked_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_line_frequency": line_quality.ORACLE_SQL, "op5_chat_collapse": chat_collapse.ORACLE_SQL, "op12_exact_dedup": exact_dedup.ORACLE_SQL, "op13_ranked_search": lexical_search.ORACLE_SQL}
