"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from credlens.llm import cuckoo, divergence, hard_negatives, langid, line_dedup, markov_secrets, mixing, repetition, sentencepiece_codec, simhash, suffix_dedup, token_files, warc
from credlens.llm.shared import read_table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.response_records(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.build_derivatives(responses, "record", "page_id")


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.find_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(read_table(spark, sf_dir, "documents", "lang", "source", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_repetition_rules": op2_repetition_rules,
    "op3_simhash_components": op3_simhash_components,
    "op4_source_mix": op4_source_mix,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_families": op6_language_families,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
    "op11_source_divergence": op11_source_divergence,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
