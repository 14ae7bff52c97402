"""Registered queries of the training-data operators, one per operator, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locflow.llm import (bpe, chat_format, exact_dedup, html_text, lexical, licences, mixing, near_text, near_vectors, prefix_trie,
                         quality, token_counts, warc)
from locflow.llm.shared import table


def _model(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(table(spark, sf_dir, "documents"))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _model("byte_bpe_50k.json"))


def op3_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _model("piece_bpe_32k.model"))


def op10_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op11_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_conversations(spark, table(spark, sf_dir, "conversations"))


def op12_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_licence_rules, op2_bpe_trie, op3_warc_chains, op4_extendible_hash, op5_rule_ensemble, op6_pca_tiles,
    op7_systematic_mix, op8_text_density, op9_token_counts, op10_hamming_join, op11_grammar_round_trip, op12_euler_trie,
    op13_length_strata)}

# Operators 1, 2, 5, 8, 9 and 10 have no SQL form; tests hold them against brute force, libraries or held-out labels.
ORACLE = {
    "op3_warc_chains": warc.oracle(),
    "op4_extendible_hash": exact_dedup.oracle(),
    "op6_pca_tiles": near_vectors.oracle(),
    "op7_systematic_mix": mixing.oracle(),
    "op11_grammar_round_trip": chat_format.oracle(),
    "op12_euler_trie": prefix_trie.oracle(),
    "op13_length_strata": lexical.oracle(),
}
