"""The numbered queries: each applies its operator with production parameters to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, infill, vectors
from .chat import collapse
from .common import table, workers_import
from .decontaminate import benchmark_leaks
from .infill import fill_in_middle, restored_sha256
from .lattice import document_scores
from .order_minhash import near_duplicates
from .packing import pack
from .passages import repeated_passages
from .quality import quality_verdicts
from .simhash import hexadecimal, simhash_components
from .suffixes import remove_repeats
from .tokens import token_counts
from .toxicity import toxicity_scores
from .vectors import vector_codes


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return document_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256("output", "form").alias("restored_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_lattice_scores, op4_compact_windows, op5_benchmark_leaks, op6_suffix_dedup, op8_chat_collapse, op7_token_counts, op9_order_minhash, op10_best_fit_packing, op11_vector_codes, op12_fill_in_middle, op13_simhash)}
ORACLES: dict[str, str] = {"op8_chat_collapse": chat.SQL, "op11_vector_codes": vectors.SQL, "op12_fill_in_middle": infill.SQL}
