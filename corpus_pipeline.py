"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. No SQL expresses the stages; tests run them on planted cases and compare their operators with brute force.

In every stage null text counts as empty, repeated rows are documents of their own, a null doc_id comes after all others, an
empty table stays empty, and columns besides doc_id and text, of whatever name, are passed on as they are (all but n_chars,
which follows a text that is cut). A text is handled whole by one task, in memory of about eighty times its size at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import stow, table, workers_import
from lodestrata.llm.decontaminate import without_leaks
from lodestrata.llm.order_minhash import one_of_each
from lodestrata.llm.packing import pack
from lodestrata.llm.passages import without_repeats
from lodestrata.llm.quality import good_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go; null, empty and short texts are among them.

    Without labels of both kinds the base rule alone decides.
    """
    workers_import(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id.

    Exact copies are a class, so one stays of all null and empty texts, and of equal rows one.
    """
    workers_import(spark)
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out; documents that this leaves without words go.

    Rows of one doc_id aren't earlier than one another. Texts without such a passage stay as they are, null ones too.
    """
    workers_import(spark)
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go; null and empty texts stay, null and empty items match nothing."""
    workers_import(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    workers_import(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stow(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
